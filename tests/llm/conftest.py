from __future__ import annotations

import pytest

#: Extra columns whose names the operators use themselves.
CLASH = "id long, row long, component_id long, kept boolean, n_words long, spans string, part int, vector string, node long, label string"


def with_clashes(rows, schema, spark):
    """A frame of ``rows`` with extra columns of clashing names."""
    names = [c.split()[0] for c in schema.split(", ")]
    extra = ", ".join(c for c in CLASH.split(", ") if c.split()[0] not in names)
    width = extra.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], f"{schema}, {extra}")


@pytest.fixture(scope="session")
def base_text():
    import random

    rng = random.Random(3)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400))


@pytest.fixture(scope="session")
def odd_docs(spark, base_text):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing names."""
    said = base_text.split()
    near = " ".join([*said[:200], "changed", *said[201:]])
    rows = [
        (1, base_text, "en"),
        (2, base_text, "en"),
        (2, base_text, "en"),
        (3, near, "en"),
        (4, None, "en"),
        (5, "", None),
        (6, " \t\n", "de"),
        (7, "Two words", "de"),
        (8, "two WORDS", "de"),
        (9, " ".join(f"w{i}" for i in range(120_000)), "fr"),
        (10, "x" * 300_000, None),
        (None, base_text, "en"),
        (11, "1234 5678 !!", "en"),
        (12, "the quick brown fox " * 30, "en"),
    ]
    return with_clashes(rows, "doc_id long, text string, lang string", spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
