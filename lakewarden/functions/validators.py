"""Structural checks on candidate values, as boolean Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Card number prefixes by brand.
CARD_PREFIXES = {
    "visa": "4",
    "mastercard": "5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720",
    "amex": "3[47]",
    "discover": "6011|65|64[4-9]",
    "jcb": "35",
    "diners": "36|38|39|30[0-5]",
}
# Numbers printed in documentation, never issued.
SSN_PLACEHOLDERS = ("123456789", "111111111", "078051120", "219099999")
KEY_PLACEHOLDERS = ("changeme", "placeholder", "your_api_key_here")
PASSWORD_PLACEHOLDERS = (
    "password",
    "changeme",
    "example",
    "redacted",
    "xxxxxx",
    "secret",
    "your_password",
    "<password>",
    "********",
    "hunter2",
)
QUOTES = "\"'`"
MIN_KEY_LENGTH = 16
MIN_KEY_ENTROPY = 3.2
MIN_PASSWORD_LENGTH = 6
NPI_ISSUER = "80840"


def _luhn_check(value: Column) -> Column:
    return F.call_function("luhn_check", value)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Mod-10 checksum over at least twelve digits."""
    d = digits(value)
    return (F.length(d) >= 12) & _luhn_check(d)


def card_number(value: Column) -> Column:
    d = digits(value)
    brand = d.rlike("^(?:" + "|".join(CARD_PREFIXES.values()) + ")")
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & brand & _luhn_check(d)


def ssn(value: Column) -> Column:
    d = digits(value)
    return d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$") & ~d.isin(*SSN_PLACEHOLDERS)


def npi(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 10) & _luhn_check(F.concat(F.lit(NPI_ISSUER), d))


def iban(value: Column) -> Column:
    """ISO 13616 mod-97, folded so that no number outgrows an int."""
    compact = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        n = F.conv(char, 36, 10).cast("int")
        return F.pmod(F.when(n < 10, rest * 10).otherwise(rest * 100) + n, F.lit(97))

    remainder = F.aggregate(F.split(turned, ""), F.lit(0), step)
    shaped = compact.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.when(shaped, remainder == 1).otherwise(F.lit(False))


def entropy(value: Column) -> Column:
    """Shannon bits per character, 0 for the empty string."""
    chars = F.split(value, "")
    size = F.length(value).cast("double")

    def bits(char: Column) -> Column:
        share = (size - F.length(F.replace(value, char, F.lit("")))) / size
        return -share * F.log2(share)

    total = F.aggregate(
        F.array_sort(F.transform(F.array_distinct(chars), bits)), F.lit(0.0), lambda a, b: a + b
    )
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(total)


def unquoted(value: Column) -> Column:
    return F.trim(value, F.lit(QUOTES))


def high_entropy(value: Column) -> Column:
    bare = unquoted(value)
    return (
        (F.length(bare) >= MIN_KEY_LENGTH)
        & ~F.lower(bare).isin(*KEY_PLACEHOLDERS)
        & (entropy(bare) >= MIN_KEY_ENTROPY)
    )


def plausible_password(value: Column) -> Column:
    bare = unquoted(value)
    return (F.length(bare) >= MIN_PASSWORD_LENGTH) & ~F.lower(bare).isin(*PASSWORD_PLACEHOLDERS)


def routable_ip(value: Column) -> Column:
    """Four octets outside the loopback, unspecified and documentation ranges."""
    reserved = r"^0*(?:0|127|255)\.|^0*192\.0*0\.|^0*198\.0*(?:18|19|51)\."
    return (F.size(F.split(value, r"\.")) == 4) & ~value.rlike(reserved)


BY_NAME = {
    "card": card_number,
    "ssn": ssn,
    "npi": npi,
    "iban": iban,
    "key": high_entropy,
    "password": plausible_password,
    "ip": routable_ip,
}
