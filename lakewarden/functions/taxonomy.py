"""The label vocabulary and everything derived from it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, name, category, severity, regulations.
LABELS: tuple[tuple[str, str, str, str, tuple[str, ...]], ...] = (
    ("pii.email", "Email address", "pii", "medium", ("GDPR", "CCPA")),
    ("pii.phone", "Phone number", "pii", "medium", ("GDPR", "CCPA")),
    ("pii.ssn", "US Social Security Number", "pii", "critical", ("GDPR", "CCPA", "GLBA")),
    ("pii.national_id", "National identity number", "pii", "critical", ("GDPR",)),
    ("pii.passport", "Passport number", "pii", "high", ("GDPR", "CCPA")),
    ("pii.drivers_license", "Driver's licence number", "pii", "high", ("GDPR", "CCPA")),
    ("pii.dob", "Date of birth", "pii", "high", ("GDPR", "CCPA", "HIPAA")),
    ("pii.address", "Postal address", "pii", "medium", ("GDPR", "CCPA")),
    ("pii.name", "Person name", "pii", "low", ("GDPR", "CCPA")),
    ("pii.ip_address", "IP address", "pii", "low", ("GDPR",)),
    ("pii.mac_address", "MAC address", "pii", "low", ("GDPR",)),
    ("pci.card_number", "Payment card number", "pci", "critical", ("PCI-DSS", "GLBA")),
    ("pci.iban", "IBAN", "pci", "high", ("PCI-DSS", "GDPR", "GLBA")),
    ("phi.mrn", "Medical record number", "phi", "critical", ("HIPAA",)),
    ("phi.npi", "National Provider Identifier", "phi", "medium", ("HIPAA",)),
    ("phi.icd10", "ICD-10 diagnosis code", "phi", "high", ("HIPAA",)),
    ("secret.private_key", "Private key", "secret", "critical", ("SOC2",)),
    ("secret.aws_access_key", "AWS access key ID", "secret", "critical", ("SOC2",)),
    ("secret.aws_secret_key", "AWS secret access key", "secret", "critical", ("SOC2",)),
    ("secret.gcp_api_key", "Google API key", "secret", "high", ("SOC2",)),
    ("secret.github_token", "GitHub token", "secret", "critical", ("SOC2",)),
    ("secret.slack_token", "Slack token", "secret", "high", ("SOC2",)),
    ("secret.stripe_key", "Stripe key", "secret", "critical", ("SOC2", "PCI-DSS")),
    ("secret.anthropic_key", "Anthropic API key", "secret", "high", ("SOC2",)),
    ("secret.openai_key", "OpenAI API key", "secret", "high", ("SOC2",)),
    ("secret.jwt", "JSON Web Token", "secret", "high", ("SOC2",)),
    ("secret.generic_api_key", "Generic API key", "secret", "high", ("SOC2",)),
    ("secret.password", "Password", "secret", "critical", ("SOC2",)),
    ("secret.db_connection_string", "Database connection string", "secret", "critical", ("SOC2",)),
    ("confidential.internal", "Internal only", "confidential", "medium", ()),
    ("confidential.legal", "Legally privileged", "confidential", "high", ()),
    ("confidential.source_code", "Proprietary source code", "confidential", "medium", ()),
    ("public.open", "Public", "public", "low", ()),
)

# Order of severities.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

KEYS = frozenset(row[0] for row in LABELS)


def expand(key: str) -> frozenset[str]:
    """Concrete labels under a key; a concrete key stands for itself."""
    return frozenset({key}) if key in KEYS else frozenset(k for k in KEYS if k.startswith(key + "."))


def is_known(key: str) -> bool:
    return bool(expand(key))


def covers_name(pattern: str, label: str) -> bool:
    return label == pattern or label.startswith(pattern + ".")


def _ancestors(key: str) -> list[str]:
    parts = key.split(".")
    return [".".join(parts[:n]) for n in range(1, len(parts))]


def _every_key() -> list[str]:
    """Concrete labels and all their prefixes."""
    return sorted(KEYS | {a for k in KEYS for a in _ancestors(k)})


_SEVERITY = {row[0]: row[3] for row in LABELS}
_REGULATIONS = {row[0]: row[4] for row in LABELS}
SEVERITY_OF = {
    k: max((_SEVERITY[c] for c in expand(k)), key=SEVERITY_RANK.__getitem__) for k in _every_key()
}
REGULATIONS_OF = {
    k: tuple(sorted({r for c in expand(k) for r in _REGULATIONS[c]})) for k in _every_key()
}


def _literal_map(pairs: Iterable[tuple[str, Column]]) -> Column:
    return F.create_map(*[c for k, v in pairs for c in (F.lit(k), v)])


def severity(label: Column) -> Column:
    """Severity of a label; of the worst child for a prefix; ``low`` for anything else."""
    table = _literal_map((k, F.lit(v)) for k, v in SEVERITY_OF.items())
    return F.coalesce(F.try_element_at(table, label), F.lit("low"))


def severity_rank(name: Column) -> Column:
    return F.try_element_at(_literal_map((k, F.lit(v)) for k, v in SEVERITY_RANK.items()), name)


def severity_name(rank: Column) -> Column:
    """The severity with a given rank; null for null."""
    names = sorted(SEVERITY_RANK, key=SEVERITY_RANK.__getitem__)
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), rank)


def regulations(labels: Column) -> Column:
    """Sorted union of the regulations the labels bring in."""
    none = F.array().cast("array<string>")
    table = _literal_map(
        (k, F.array(*[F.lit(r) for r in v]) if v else none) for k, v in REGULATIONS_OF.items()
    )
    each = F.transform(labels, lambda label: F.coalesce(F.try_element_at(table, label), none))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def covers(pattern: Column | str, label: Column) -> Column:
    """``label`` is ``pattern`` or lies beneath it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return (label == pattern) | F.startswith(label, F.concat(pattern, F.lit(".")))


def ancestors(label: Column) -> Column:
    """``a.b.c`` gives ``[a, a.b]``."""
    parts = F.split(label, r"\.")
    last = F.size(parts) - 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, 1, n), ".")),
    ).otherwise(F.array().cast("array<string>"))


def labels_table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table; 33 rows, so always safe to broadcast."""
    return spark.createDataFrame(
        [(k, n, c, s, SEVERITY_RANK[s], list(r)) for k, n, c, s, r in LABELS],
        "key string, name string, category string, severity string, severity_rank int,"
        " regulations array<string>",
    )


def expansion_table(spark: SparkSession) -> DataFrame:
    """Every key, concrete or prefix, with each concrete label it stands for."""
    return spark.createDataFrame(
        [(k, c) for k in _every_key() for c in sorted(expand(k))], "key string, label string"
    )
