"""Language of a text by cross-parsing.

For each language a suffix automaton holds all substrings of some labelled text. A new text is
parsed against it: the longest match from each place on is one phrase, and the next phrase starts
where it ended. Text of the automaton's language parses into few long phrases, so the language with
the lowest ``phrases * log2(labelled letters) / letters``, the cross-parsing estimate of the bits
per letter, wins.

Phrases end with the word they stand in, so the phrases of a word depend on the word alone: each
worker parses a word once and remembers its phrases in all languages as the digits of one number. A
text's phrases are then one sum over its words, whole texts included.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm import common

UNDETERMINED = "und"
#: Bounds of the labelled sample: rows per language, and letters and blanks of each language's automaton.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 40_000
#: Words remembered per worker, in each of two generations.
_REMEMBERED = 100_000
_WORDS = re.compile(r"[^\W\d_]+")
_DIGIT = 40


class SuffixAutomaton:
    """All substrings of a text; built in time proportional to it.

    Steps stand in one table, from (state, letter) to state, which takes a fraction of the memory
    that a table per state does.
    """

    def __init__(self, text: str) -> None:
        self.codes = {c: i for i, c in enumerate(sorted(set(text)))}
        self.width = max(len(self.codes), 1)
        below: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in map(self.codes.__getitem__, text):
            new = len(below)
            below.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in below[p]:
                below[p][c] = new
                p = link[p]
            if p >= 0:
                q = below[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(below)
                    below.append(dict(below[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and below[p].get(c) == q:
                        below[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step = {state * self.width + c: to for state, steps in enumerate(below) for c, to in steps.items()}

    def phrases(self, text: str) -> int:
        """Longest matches, one after the other, that ``text`` takes; a letter never seen is one of its own."""
        step, codes, width, state, count = self.step, self.codes, self.width, 0, 1
        for c in text:
            code = codes.get(c)
            to = None if code is None else step.get(state * width + code)
            if to is None:
                if state:
                    count += 1
                    to = None if code is None else step.get(code)
                if to is None:
                    to = 0
                    count += 1
            state = to
        return count


class _Parsed(dict):
    """Phrases by word: language ``i``'s in the ``i``-th digit of ``_DIGIT`` bits."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[x]) for x in self.langs]
        self.bits = [math.log2(max(len(texts[x]), 2)) for x in self.langs]
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            # Words in use come back from the older generation; the others go with it.
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            spaced = f" {word} "
            found = sum(a.phrases(spaced) << (_DIGIT * i) for i, a in enumerate(self.automata))
        self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def _parsed(model: tuple[tuple[str, str], ...]) -> _Parsed:
    return _Parsed(dict(model))


def classify(text: str, model: tuple[tuple[str, str], ...]) -> tuple[str, float]:
    """``(language, score)`` of one text; ties go to the first language in the alphabet."""
    said = _WORDS.findall(text.lower())
    if not said or not model:
        return UNDETERMINED, 0.0
    parsed = _parsed(model)
    total = sum(map(parsed.__getitem__, said))
    letters = sum(map(len, said))
    mask = (1 << _DIGIT) - 1
    rates = sorted(((total >> (_DIGIT * i)) & mask) * bits / letters for i, bits in enumerate(parsed.bits))
    scored = [((total >> (_DIGIT * i)) & mask) * bits / letters for i, bits in enumerate(parsed.bits)]
    best = scored.index(rates[0])
    return parsed.langs[best], (1.0 if len(rates) == 1 else rates[1] / (rates[0] + rates[1]))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, text)`` of the labelled rows that the model learns from, ``SAMPLE_ROWS`` of each language.

    Rows are taken in the order of a hash of their id, first by id alone, so that no text is shuffled.
    """
    fit = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = fit.select("id", "lang").withColumn("n", F.row_number().over(turn)).where(F.col("n") <= SAMPLE_ROWS).select("id").distinct()
    # At most SAMPLE_ROWS ids of each language: the bound is the parameter times the number of languages.
    return fit.join(F.broadcast(chosen), "id", "left_semi").select("id", "lang", "text")


def fit(rows: DataFrame) -> tuple[tuple[str, str], ...]:
    """``(language, labelled words)`` pairs from ``training_rows``, ``SAMPLE_CHARS`` characters of each language at most."""
    texts: dict[str, list[str]] = {}
    kept = rows.select("lang", "id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    for lang, _, text in sorted(kept.collect(), key=lambda r: (r[0], hash_order(r[1]), r[2])):
        texts.setdefault(lang, []).append(" ".join(_WORDS.findall(text.lower())))
    joined = {lang: f" {' '.join(filter(None, said))} "[:SAMPLE_CHARS] for lang, said in texts.items()}
    return tuple(sorted((lang, text) for lang, text in joined.items() if text.strip()))


def hash_order(value: object) -> int:
    """An order of ids that does not follow their size."""
    import zlib

    return zlib.crc32(str(value).encode())


def predictor(spark: SparkSession, model: tuple[tuple[str, str], ...]):
    """A function from a text column to a column ``struct<lang, score>``; null texts and texts without a letter are ``und``."""
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages times SAMPLE_CHARS at most

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        known = shared.value
        found = [classify(t.as_py() or "", known) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang", "score"]
        )

    return lambda column: run(F.col(column))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each row of ``docs``.

    The model learns from the labelled rows that are not held out; predictions see the text alone.
    ``score`` is the runner-up's share of the two lowest rates, a half for a tie and 0 for ``und``.
    Without labelled rows every text is ``und``. A row without an id is neither learned from nor held out.
    """
    found = predictor(docs.sparkSession, fit(training_rows(docs, id_col, text_col, lang_col)))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), found(text_col).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
