"""Token counts, alignment of two tokenizers and resampling against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lakewarden.llm import align, bpe, resample, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def texts_of(n, seed):
    """Texts of odd characters: blanks of all kinds, marks, digits, letters in and outside ASCII, unassigned ones, special strings."""
    rng = random.Random(seed)
    some = ["a", "the", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "7", "٣", "½", "é", "é", "中", "\U0001f600", "▁", "͸", "\U0003fc3b"]
    some += ["<|endoftext|>", "<s>", "<0x41>", "!?", "'", "''ll", "\x00", "​", "Wort", "don't", "\r\n"]
    return ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(n)]


def documents():
    return duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' order by 1").fetchall()


# --- token counts


def library(text):
    return len(tokenizers.Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    known, model = token_counts.counter(VOCABULARY), tokenizers.Tokenizer.from_file(VOCABULARY)
    for text in [*texts_of(3000, 1), *(t for _, t in documents())]:
        assert known.tokens(text) == len(model.encode(text, add_special_tokens=False).ids), text


def test_merges_take_the_lowest_rank_first():
    ranks = {("a", "b"): 2, ("b", "c"): 1, ("a", "bc"): 3, ("a", "a"): 0, ("aa", "a"): 4}
    assert token_counts.merges("abc", ranks) == 2 and token_counts.merges("aaa", ranks) == 2
    assert token_counts.merges("", ranks) == token_counts.merges("a", ranks) == token_counts.merges("cb", ranks) == 0


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 30_000, "é" * 10_000, "<|endoftext|>" * 500, "x<|endoftext|> y", "  " * 9000])
def test_counts_of_long_runs(text):
    assert token_counts.counter(VOCABULARY).tokens(text) == library(text)


def test_runs_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(token_counts, "_REMEMBERED", 10)
    known = token_counts.Counter(VOCABULARY)
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert known.tokens(text) == library(text)
    assert all(0 < len(x) <= 10 and len(x.older) <= 10 for x in (known.runs, known.cuts))
    assert known.tokens("x " + "y" * 100) == library("x " + "y" * 100) and " " + "y" * 100 not in known.runs


def test_counts_odd_rows(odd_docs, no_docs):
    got = token_counts.counts(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = {(r.doc_id, r.text): r for r in odd_docs.collect()}
    found = {r.doc_id: r for r in got}
    for (doc_id, text), _ in want.items():
        assert (found[doc_id].n_tokens, found[doc_id].n_bytes) == (library(text or ""), len((text or "").encode()))
        assert found[doc_id].over_limit == (found[doc_id].n_tokens > 1024)
    assert (found[4].n_tokens, found[4].n_bytes, found[4].over_limit) == (0, 0, False)
    assert token_counts.counts(no_docs).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


# --- alignment


def plain_alignment(rows):
    """Measures by walking both token lists side by side."""
    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spelled = {i: b for b, i in bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)._mergeable_ranks.items()}

    def bytes_of(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    found, count = [], Counter()
    for doc_id, text in rows:
        said = " " + (text or "")
        a = model.encode(said, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if any(b"".join(x) != said.encode() for x in ([spelled[i] for i in a], [bytes_of(i) for i in b])):
            a, b = [], []
        groups, links, i, j, at_a, at_b, left, right = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a) and not (at_a == at_b and left):
                left.append(a[i])
                at_a += len(spelled[a[i]])
                i += 1
            else:
                right.append(b[j])
                at_b += len(bytes_of(b[j]))
                j += 1
            if at_a == at_b and left and right:
                groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                links.append((left[-1], right[-1]))
                left, right = [], []
        count.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(
        (str(d), a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, x in found
    )


def aligned(frame, **more):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in align.align(frame, **more).select(columns).collect())


def test_alignment_equals_a_plain_walk(spark):
    rows = [*documents(), *((1_000_000 + i, t) for i, t in enumerate(texts_of(300, 2) * 2)), (5, None), (5, ""), (None, "same text"), (6, "same text"), (6, "same text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_alignment(rows)
    assert aligned(frame) == want
    assert sum(r[1] > 0 for r in want) > 300 and any(r[1] == 0 for r in want)
    assert aligned(frame, block=3000) == want  # the blocks change nothing


def test_alignment_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert aligned(odd_docs) == plain_alignment(rows)
    assert align.align(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, "▁"), (2, None)], "doc_id long, text string")
    assert [r[1:] for r in aligned(nothing)] == [(0, 0, 0, 0, 0, 0, "")] * 2


# --- resampling


def plain_resample(rows, target, buckets=10_000, least=20, percent=5, seed=42):
    def grams(text):
        said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(said), [" ".join(said[i : i + n]) for n in (1, 2, 3) for i in range(len(said) - n + 1)]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    held = [(d, *grams(t)) for d, t in rows]
    s, t = Counter(bucket(g) for _, _, x in held for g in x), Counter(bucket(g) for x in target for g in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[k] + 1) * (big_s + buckets)) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)]
    scored = []
    for d, n, x in held:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in x)
        scored.append((d, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(r[0], *r[2:], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted([*drawn, *((r[0], *r[2:], None) for r in scored if r[1] < least)], key=str)


def drawn(frame, target, **more):
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in resample.resample(frame, target, **more).select(columns).collect()), key=str)


@pytest.mark.parametrize("percent, buckets", [(5, 10_000), (60, 97), (100, 1), (0, 10)])
def test_resample_equals_plain_python(spark, percent, buckets):
    rows = [*documents(), *((1000 + i, f"{t} Word-wordÉ {t}") for i, t in enumerate(texts_of(100, 4)))]
    target = [r[0] for r in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in [*target, None]], "text string")
    got = drawn(frame, wanted, percent=percent, buckets=buckets)
    assert got == plain_resample(rows, target, buckets, percent=percent)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1))


def test_resample_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    assert drawn(odd_docs, target, percent=50) == plain_resample(rows, ["the quick brown fox"], percent=50)
    assert drawn(odd_docs, target.limit(0), percent=100) == plain_resample(rows, [], percent=100)
    assert drawn(no_docs, target) == []


def test_ranks_of_many_ties(spark):
    frame = spark.range(0, 5000, 1, 9).select((F.col("id") % 7).alias("k"), F.col("id").alias("place_of"))
    got = resample.ranked(frame, [F.col("k").desc(), F.col("place_of")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001))
    assert [(-r.k, r.place_of) for r in got] == sorted((-(i % 7), i) for i in range(5000))
