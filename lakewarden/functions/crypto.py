"""Keyed digests, canonical JSON and reversible tokens as Column expressions.

Keys are handled on the driver only long enough to derive padded or stretched
literals; every digest and cipher runs in the JVM.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_PREFIX = "tok_"
TOKEN_VERSION = 1
TOKEN_NONCE_BYTES = 12
TOKEN_TAG_BYTES = 16
#: Domain-separation string of the key stretch. A deployment that must read tokens minted
#: elsewhere passes the string those were minted under.
TOKEN_INFO = b"tokenization/v1"

#: Stand-in keys used when none is configured.
UNKEYED_DIGEST = b"content-digest"
UNKEYED_REDACTION = b"unkeyed-redactor"


def _utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary or string column."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in block))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def content_digest(text: Column, key: bytes = b"") -> Column:
    """Keyed digest of content that must not be stored verbatim."""
    return hmac_sha256(key or UNKEYED_DIGEST, _utf8(text))


# --------------------------------------------------------------------------- canonical JSON

_SHORT_ESCAPES = {
    '"': '\\"',
    "\\": "\\\\",
    "\n": "\\n",
    "\r": "\\r",
    "\t": "\\t",
    "\b": "\\b",
    "\f": "\\f",
}


def _u_escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escape_char(char: Column) -> Column:
    code = F.ascii(char)
    rest = code - 0x10000
    astral = F.concat(
        _u_escape(F.lit(0xD800) + F.shiftright(rest, 10)),
        _u_escape(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))),
    )
    branch = F.when(char.rlike(r'^[ !#-\[\]-~]$'), char)
    for plain, escaped in _SHORT_ESCAPES.items():
        branch = branch.when(char == F.lit(plain), F.lit(escaped))
    return branch.when(code > 0xFFFF, astral).otherwise(_u_escape(code))


def json_string(text: Column) -> Column:
    """A JSON string literal in pure ASCII."""
    escaped = F.array_join(F.transform(F.split(text, ""), _escape_char), "")
    body = F.when(text.rlike(r'^[ !#-\[\]-~]*$'), text).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def iso_utc(ts: Column) -> Column:
    """``2024-01-01T00:00:00.000001+00:00``; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def canonical_json(value: Column, dtype: T.DataType) -> Column:
    """Byte-stable JSON: sorted keys, no spaces, ASCII only, UTC ISO times, hex bytes.

    Doubles are rendered as Spark casts them to string.
    """
    null = F.lit("null")
    if isinstance(dtype, T.StringType):
        text = json_string(value)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), iso_utc(value), F.lit('"'))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))
    elif isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        parts = [
            F.concat(F.lit(f'"{f.name}":'), canonical_json(value.getField(f.name), f.dataType))
            for f in fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_keys(value))
        items = F.transform(
            entries,
            lambda k: F.concat(json_string(k), F.lit(":"), canonical_json(value[k], dtype.valueType)),
        )
        text = F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda v: canonical_json(v, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    else:
        text = value.cast("string")
    return F.coalesce(text, null)


# --------------------------------------------------------------------------- tokens


def stretch_key(key: bytes, info: bytes = TOKEN_INFO) -> tuple[bytes, bytes]:
    """HKDF-SHA256 of one configured key into a digest key and a cipher key."""
    if not key:
        raise ValueError("tokenisation needs a key")
    extracted = hmac.new(b"\0" * 32, key, hashlib.sha256).digest()
    first = hmac.new(extracted, info + b"\x01", hashlib.sha256).digest()
    second = hmac.new(extracted, first + info + b"\x02", hashlib.sha256).digest()
    return first, second


def _b64url(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


def _un_b64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64"))


def token(label: Column, value: Column, key: bytes, info: bytes = TOKEN_INFO, max_bytes: int | None = None) -> Column:
    """The deterministic token of a value under a label; null past ``max_bytes``, where the caller sets them."""
    prf, enc = stretch_key(key, info)
    raw = _utf8(value)
    seed = F.concat(_utf8(label), F.lit(b"\0"), raw)
    nonce = F.substring(F.unhex(hmac_sha256(prf, seed)), 1, TOKEN_NONCE_BYTES)
    # GCM output is nonce || ciphertext || tag, which is the token body after the version byte.
    sealed = F.aes_encrypt(raw, F.lit(enc), F.lit("GCM"), F.lit("DEFAULT"), nonce)
    body = _b64url(F.concat(F.lit(bytes([TOKEN_VERSION])), sealed))
    made = F.concat(F.lit(TOKEN_PREFIX), body)
    return made if max_bytes is None else F.when(F.octet_length(raw) <= max_bytes, made)


def looks_like_token(text: Column) -> Column:
    return F.startswith(text, F.lit(TOKEN_PREFIX)) & (F.length(text) > len(TOKEN_PREFIX) + 16)


def detoken(
    text: Column, key: bytes, retired: Sequence[bytes] = (), info: bytes = TOKEN_INFO
) -> Column:
    """The original value, or null for anything unreadable, without saying why."""
    blob = _un_b64url(F.substring(text, len(TOKEN_PREFIX) + 1, 2**31 - 1))
    sealed = F.substring(blob, 2, 2**31 - 1)
    tries = []
    for candidate in (key, *[k for k in retired if k]):
        _, enc = stretch_key(candidate, info)
        plain = F.try_aes_decrypt(sealed, F.lit(enc), F.lit("GCM"))
        tries.append(F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")))
    shaped = (
        F.startswith(text, F.lit(TOKEN_PREFIX))
        & (F.octet_length(blob) >= 1 + TOKEN_NONCE_BYTES + TOKEN_TAG_BYTES)
        & (F.hex(F.substring(blob, 1, 1)) == f"{TOKEN_VERSION:02X}")
    )
    return F.when(shaped, F.coalesce(*tries))


def token_matches(label: Column, value: Column, text: Column, key: bytes) -> Column:
    """Whether a token stands for a value, without reversing it."""
    return F.coalesce(token(label, value, key) == text, F.lit(False))
