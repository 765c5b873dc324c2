"""Token counts by merging byte pairs, without making a token.

A text is cut as the vocabulary file's own splitter cuts it. Each cut is a linked list of symbols, one
per byte; a heap holds its adjacent pairs by the rank of their merge, and the lowest rank, the
leftmost among equals, is merged until no pair has one. The count is the number of symbols less the
number of merges. A cut of ``n`` bytes takes ``n log n`` steps, however long it is.

Texts repeat their words, so a worker remembers counts twice: of runs, which are non-blanks with the
blank before them, and of the cuts within them. Blanks part the splitter's cuts in the same way, so
the counts of runs add up. Two generations bound what is remembered; long runs never are.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import bpe, common

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Runs and cuts remembered per worker, in each of two generations, and the longest remembered.
_REMEMBERED, _LONGEST = 200_000, 64
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Blank for Python, but not for the splitter; texts that hold one are cut by the splitter alone.
_ODD = re.compile("[\x1c-\x1f]")
#: The splitter's cuts of an ASCII run without those.
_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def merges(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many merges ``symbols`` takes until no adjacent pair has a rank."""
    size = len(symbols)
    parts: list[str | None] = list(symbols)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= size or parts[j] != right:
            continue  # one of the two has been merged since
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < size:
            before[after[j]] = i
        done += 1
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < size and (rank := ranks.get(pair := (parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (rank, a, pair))
    return done


def byte_names() -> dict[str, str]:
    """What a byte is called in the vocabulary file, and the byte as a character: printable ones are their own name, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [c for c in range(0x100) if c not in own]
    return {chr(c): chr(c) for c in own} | {chr(0x100 + k): chr(c) for k, c in enumerate(rest)}


class Memory(dict):
    """Counts by string; what ``find`` gives is remembered in two generations."""

    def __init__(self, find: Callable[[str], int]) -> None:
        self.find = find
        self.older: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        if len(run) > _LONGEST:
            return self.find(run)
        if len(self) >= _REMEMBERED:
            # Runs in use come back from the older generation; the others go with it.
            self.older = dict(self)
            self.clear()
        found = self.older.get(run)
        if found is None:
            found = self.find(run)
        self[run] = found
        return found


class Counter:
    """Tokens of texts by one vocabulary file."""

    def __init__(self, path: str) -> None:
        model = tokenizers.Tokenizer.from_file(path)
        said = json.loads(model.to_str())
        bpe_model, added, before = said["model"], said["added_tokens"], said["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if bpe_model.get(k)]
        odd += ["normalizer"] * bool(said["normalizer"]) + [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if bpe_model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or odd:
            raise ValueError(f"{path} is no plain byte-level BPE: {odd or [bpe_model['type'], before]}")
        self.split = model.pre_tokenizer.pre_tokenize_str
        names = str.maketrans(byte_names())
        self.ranks = {(a.translate(names), b.translate(names)): rank for rank, (a, b) in enumerate(bpe_model["merges"])}
        spelled = sorted((t["content"] for t in added), key=len, reverse=True)
        # Longer names first, so that the longest of those that begin at one place counts.
        self.special = re.compile("|".join(map(re.escape, spelled))) if spelled else None
        self.cuts, self.runs = Memory(self.merged), Memory(self.cut)

    def merged(self, cut: str) -> int:
        """Tokens of one cut."""
        symbols = cut.encode().decode("latin-1")
        return len(symbols) - merges(symbols, self.ranks)

    def cut(self, run: str) -> int:
        """Tokens of a run that spells no added token."""
        if run.isascii() and not _ODD.search(run):
            cuts = _CUTS.findall(run)
        else:
            cuts = [run[a:b] for _, (a, b) in self.split(run)]
        return sum(map(self.cuts.__getitem__, cuts))

    def tokens(self, text: str) -> int:
        """Tokens of ``text``; an added token spelled in it is one token and parts what stands beside it."""
        total = 0
        pieces = [text]
        if self.special is not None:
            pieces = self.special.split(text)
            total = len(pieces) - 1
        for piece in filter(None, pieces):
            if _ODD.search(piece):
                total += self.cut(piece)
            else:
                total += sum(sum(map(self.runs.__getitem__, _RUNS.findall(part))) for part in bpe.parts(piece))
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each row of ``docs``.

    ``n_tokens`` is what the ``tokenizers`` library gives for the whole text and the vocabulary file,
    a byte-level BPE, without tokens put around it; an added token spelled in a text is one token, as
    is the library's default. ``n_bytes`` is the length in UTF-8. A null text counts as empty: no
    bytes, no tokens. Ids may repeat or be null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            found = [known.tokens(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
