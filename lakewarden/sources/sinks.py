"""Writing decisions, findings and audit records. Nothing here overwrites or deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns that hold matched values or payload and never reach a stored table.
NEVER_STORED = ("value", "payload", "payload_out", "payload_findings", "edits")


def append_audit(sealed: DataFrame, path: str) -> None:
    """Append sealed records, laid out by stream so verification prunes to what it reads."""
    sealed.write.mode("append").partitionBy("stream").parquet(path)


def append_records(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Append decision or finding rows without any sensitive value."""
    safe = rows.drop(*[c for c in NEVER_STORED if c in rows.columns])
    writer = safe.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def stored_findings(findings: DataFrame) -> DataFrame:
    """Findings in the only form that may be kept: masked."""
    return findings.drop("value")
