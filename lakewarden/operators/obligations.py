"""The shape of an obligation and Columns that read arrays of them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# One column type for every obligation, so arrays of them can be compared and deduplicated.
OBLIGATION = (
    "struct<type:string,labels:array<string>,strategy:string,keep_last:int,hash_length:int,"
    "max_rows:bigint,max_bytes:bigint,max_tokens:bigint,max_results:bigint,text:string,"
    "purposes:array<string>,to:string,"
    "require:array<struct<key:string,values:array<string>,scalar:boolean>>,resolved:string>"
)
OBLIGATIONS = f"array<{OBLIGATION}>"

# The supported types, what each needs one of, and who carries it out.
NEEDS_ONE_OF = {
    "redact": ("labels", "classifications"),
    "limit": ("max_rows", "max_bytes", "max_tokens", "max_results"),
    "watermark": ("text",),
    "route": ("to", "require"),
    "require_purpose": ("purposes",),
}
DONE_BY_DECISION = ("redact",)
STRATEGIES = ("mask", "partial", "hash", "tokenize", "synthetic", "drop")
LIMITS = ("max_rows", "max_bytes", "max_tokens", "max_results")


def shaped(document: Mapping[str, Any]) -> dict[str, Any]:
    """An obligation document in the column's shape, defaults filled in."""
    kind = str(document["type"]).strip().lower()
    out: dict[str, Any] = {"type": kind}
    if kind == "redact":
        labels = document.get("labels") or document.get("classifications") or ["*"]
        out["labels"] = [labels] if isinstance(labels, str) else [str(x) for x in labels]
        out["strategy"] = str(document.get("strategy", "mask")).lower()
        out["keep_last"] = int(document.get("keep_last", 4))
        out["hash_length"] = int(document.get("hash_length", 16))
    for name in (*LIMITS, "text", "purposes", "to"):
        if document.get(name) is not None:
            out[name] = document[name]
    if document.get("require"):
        out["require"] = [
            {
                "key": str(k),
                "values": [str(x) for x in v] if isinstance(v, (list, tuple, set)) else [str(v)],
                "scalar": not isinstance(v, (list, tuple, set)),
            }
            for k, v in document["require"].items()
        ]
    return out


def literal(documents: Iterable[Mapping[str, Any]]) -> Column:
    """An array of obligations as a constant."""
    text = json.dumps([shaped(d) for d in documents])
    return F.from_json(F.lit(text), OBLIGATIONS)


def of_type(obligations: Column, kind: str) -> Column:
    return F.filter(obligations, lambda o: o["type"] == kind)


def types_of(obligations: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(obligations, lambda o: o["type"])))


def tightest(obligations: Column, limit: str) -> Column:
    """The smallest value of a limit over all limit obligations, or null."""
    return F.array_min(F.transform(of_type(obligations, "limit"), lambda o: o[limit]))


def merged(first: Column, second: Column) -> Column:
    """Duties of two decisions together, exact duplicates once."""
    return F.array_distinct(F.concat(first, second))
