"""Format-preserving pseudonyms for personal data in texts.

A value counts only if it is valid as what it looks like: a card number passes Luhn, an IBAN its
remainder, a date the calendar, a telephone or social security number its numbering plan. A valid
value is replaced by a keyed permutation of its format: a Feistel network over the numbers of the
format, walked on until the result is valid again. Equal values get equal pseudonyms in every
document and on every run with the same key, different values of one format different ones, and
separators stay where they were. Check digits are computed anew. Where a number or word follows a
value like one more group of it, the shorter readings that end at a group are validated as well.

Texts are rewritten row by row where they lie; no shuffle, and nothing is remembered between rows.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import common

ROUNDS = 8


class Feistel:
    """Keyed permutations of ``range(size)``, one for each ``tweak``."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32, person=b"pseudonyms").digest()

    def _round(self, tweak: bytes, turn: int, value: int, below: int) -> int:
        width = (value.bit_length() + 7) // 8
        said = b"%d|%b|" % (turn, tweak) + value.to_bytes(width, "big")
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big") % below

    def __call__(self, value: int, size: int, tweak: bytes) -> int:
        """Where ``value`` goes; steps out of range are walked on, which keeps the permutation."""
        if not 0 <= value < size:
            raise ValueError("value outside its domain")
        if size < 2:
            return value
        low = 1 << (((size - 1).bit_length() + 1) // 2)
        while True:
            a, b = divmod(value, low)
            for turn in range(ROUNDS):
                a, b = b, (a + self._round(tweak, turn, b, low)) % low
            value = a * low + b
            if value < size:
                return value

    def walk(self, value: int, size: int, tweak: bytes, valid: Callable[[int], bool]) -> int:
        """The permutation restricted to the valid numbers, of which ``value`` is one."""
        while True:
            value = self(value, size, tweak)
            if valid(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(like: str, symbols: str) -> str:
    """``symbols`` in the places of the letters and digits of ``like``."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in like)


def card(f: Feistel, text: str) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    # The leading digit names the kind of card and stays.
    body = f.walk(int(d[1:n]), 10 ** (n - 1), b"card%d%c" % (n, d[0].encode()), lambda v: True)
    known = d[0] + str(body).zfill(n - 1)
    return _refill(text, known + next(c for c in "0123456789" if luhn(known + c)))


def phone(f: Feistel, text: str) -> str | None:
    d = _digits(text)
    national = d[-10:]

    def plan(v: int) -> bool:
        s = str(v).zfill(10)
        return s[0] > "1" and s[3] > "1" and s[1:3] != "11" and s[4:6] != "11"

    if len(national) != 10 or d[:-10] not in ("", "1") or not plan(int(national)):
        return None
    return _refill(text, d[:-10] + str(f.walk(int(national), 10**10, b"phone", plan)).zfill(10))


def abroad(f: Feistel, text: str) -> str | None:
    """A number with a country code: 8 to 15 digits, of which the first group stays."""
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    kept = min(len(re.match(r"\+(\d+)", text).group(1)), 2)
    rest = d[kept:]
    # A significant number starts with another digit than zero and keeps doing so.
    fits = lambda v: (str(v).zfill(len(rest))[0] == "0") == (rest[0] == "0")
    return _refill(text, d[:kept] + str(f.walk(int(rest), 10 ** len(rest), b"abroad%d" % len(rest) + d[:kept].encode(), fits)).zfill(len(rest)))


def ssn(f: Feistel, text: str) -> str | None:
    d = _digits(text)

    def plan(v: int) -> bool:
        s = str(v).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    return _refill(text, str(f.walk(int(d), 10**9, b"ssn", plan)).zfill(9)) if plan(int(d)) else None


def iban(f: Feistel, text: str) -> str | None:
    s = re.sub(r"\s", "", text)
    numbers = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or numbers(s[4:] + s[:4]) % 97 != 1:
        return None
    value, size = 0, 1
    for c in s[4:]:
        radix = 10 if c.isdigit() else 26
        value, size = value * radix + (int(c) if c.isdigit() else ord(c) - 65), size * radix
    value = f(value, size, b"iban" + s[:2].encode() + str(len(s)).encode())
    body = []
    for c in reversed(s[4:]):
        value, k = divmod(value, 10 if c.isdigit() else 26)
        body.append(str(k) if c.isdigit() else chr(65 + k))
    body = "".join(reversed(body))
    return _refill(text, f"{s[:2]}{98 - numbers(body + s[:2] + '00') % 97:02d}{body}")


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(f: Feistel, text: str) -> str | None:
    parts = re.split(r"([-./])", text)
    years_first = len(parts[0]) == 4
    year, month, day = (parts[0], parts[2], parts[4]) if years_first else (parts[4], parts[2], parts[0])
    swapped = not years_first and int(month) > 12
    if swapped:
        month, day = day, month
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= at <= _LAST:
        return None
    # One permutation of days for all spellings, so that a date stays linked however it is written. A month or
    # day of one digit stays one, and a day that cannot be a month too, so that each spelling keeps its form.
    kind = lambda d: (d.month < 10, (d.day > 9) + (d.day > 12))
    own = kind(datetime.date.fromordinal(at))
    fits = lambda v: kind(datetime.date.fromordinal(_FIRST + v)) == own
    new = datetime.date.fromordinal(_FIRST + f.walk(at - _FIRST, _LAST - _FIRST + 1, b"date", fits))
    spelled = [f"{new.day:0{len(day)}d}", f"{new.month:0{len(month)}d}"]
    if swapped:
        spelled.reverse()
    spelled = [f"{new.year:04d}", *spelled[::-1]] if years_first else [*spelled, f"{new.year:04d}"]
    return f"{spelled[0]}{parts[1]}{spelled[1]}{parts[3]}{spelled[2]}"


def ipv4(f: Feistel, text: str) -> str | None:
    octets = [int(p) for p in text.split(".")]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    public = lambda v: 0 < v >> 24 < 224 and v >> 24 not in (10, 127)
    value = int.from_bytes(bytes(octets), "big")
    if not public(value):
        return None
    return ".".join(map(str, f.walk(value, 1 << 32, b"ipv4", public).to_bytes(4, "big")))


def _symbols(f: Feistel, text: str, kind: bytes) -> str:
    """Letters and digits permuted within their own kind; all else stays. Capitals stay where they are and change nothing else."""
    radix = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
    held = [c for c in text if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, r in zip(held, radix, strict=True):
        value, size = value * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
    value, new = f(value, size, kind + re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", text)).encode()), []
    for c, r in zip(reversed(held), reversed(radix), strict=True):
        value, k = divmod(value, r)
        new.append(str(k) if r == 10 else chr((65 if c.isupper() else 97) + k))
    rest = iter(reversed(new))
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in text)


def email(f: Feistel, text: str) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{_symbols(f, name, b'email' + domain.lower().encode())}@{domain}"


def hexadecimal(f: Feistel, text: str) -> str | None:
    new = f"{f(int(text, 16), 16 ** len(text), b'hex%d' % len(text)):0{len(text)}x}"
    return new.upper() if text.upper() == text and text.lower() != text else new


def access_key(f: Feistel, text: str) -> str | None:
    return text[:4] + _symbols(f, text[4:], b"access")


#: Kinds in the order in which they are tried at a place.
KINDS: dict[str, tuple[str, Callable[[Feistel, str], str | None]]] = {
    "email": (r"[A-Za-z0-9](?:[\w.+%-]{0,62}[\w+%-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b", email),
    "access_key": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", access_key),
    "secret": (r"(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![0-9A-Za-z])", hexadecimal),
    "iban": (r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b", iban),
    # The two separators of a date are the same.
    "date": (r"(?<![\d./-])(?:\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", date),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ipv4),
    "card": (r"(?<!\d)\d{4}(?:[ -]?\d{2,7}){2,4}(?!\d)", card),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    "phone": (r"(?<![\d.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", phone),
    "abroad": (r"(?<![\w)])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?!\d)", abroad),
}
_KIND = {kind: re.compile(pattern, re.ASCII) for kind, (pattern, _) in KINDS.items()}
#: Every value holds one of these, and is looked for around it only.
_SIGN = re.compile(r"[0-9@=A]")
_RUN = re.compile(r"[A-Za-z0-9]*")
_NAME = re.compile(r"[\w.+%-]{1,64}\Z", re.ASCII)
_KEYWORD = re.compile(r"(?i:password|token|secret|passwd|api_key|apikey)\"? ?\Z")
_OPENING = re.compile(r' ?["\']?')
#: Kinds written in groups, which a neighbouring number or word may follow like one more group.
_GROUPED = ("iban", "card", "phone", "abroad")
_GROUP_END = re.compile(r"(?<=[A-Z0-9)])(?![A-Z0-9)])", re.ASCII)
_GROUP_START = re.compile(r"(?<=[ .-])\d", re.ASCII)
_IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Beginnings and numbers of digits in which cards are issued.
_ISSUED = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}"
    r"|3(?:0[0-5]|[689]\d)\d{11,16}|35\d{14,17}|6\d{15,18}",
    re.ASCII,
)


def _tries(text: str, sign: int, since: int) -> Iterator[tuple[str, int]]:
    """``(kind, start)`` of the values that may stand around the sign at ``sign``, none of which starts before ``since``."""
    c = text[sign]
    if c == "@":
        name = _NAME.search(text, max(since, sign - 64), sign)
        if name:
            # A dot or the like before the name's first letter or digit is not part of it.
            yield "email", name.start() + next((i for i, x in enumerate(name.group()) if x.isascii() and x.isalnum()), 0)
    elif c == "A":
        if text.startswith(("KIA", "SIA"), sign + 1):
            yield "access_key", sign
    elif c == "=":
        if _KEYWORD.search(text, max(0, sign - 12), sign):
            yield "secret", _OPENING.match(text, sign + 1).end()
    else:
        if sign - 2 >= since:
            yield "iban", sign - 2
        if sign - 1 >= since and text[sign - 1] in "+(":
            yield "phone", sign - 1
            if text[sign - 1] == "+":
                yield "abroad", sign - 1
        if sign - 1 >= since and text[sign - 1] == "(" and sign - 3 >= since and text[sign - 3] == "1":
            yield "phone", sign - 3
        for kind in ("date", "ipv4", "card", "ssn", "phone"):
            yield kind, sign


def _likeness(text: str) -> tuple[bool, bool, int]:
    """The order in which readings as a card are tried: one group first, then issued numbers, then longer ones."""
    return not text.isdigit(), not _ISSUED.fullmatch(_digits(text)), -len(text)


def _ends(kind: str, text: str, start: int, last: int) -> list[int]:
    """Where a value may end that starts at ``start``: after any of its groups up to ``last``, in the order to try."""
    ends = [m.start() for m in _GROUP_END.finditer(text, start, last) if m.start() < last and _KIND[kind].fullmatch(text, start, m.start())]
    ends = [last, *reversed(ends)]
    if kind == "iban":
        return sorted(ends, key=lambda end: _IBAN_LENGTH.get(text[start : start + 2]) != len(text[start:end].replace(" ", "")))
    return sorted(ends, key=lambda end: _likeness(text[start:end])) if kind == "card" else ends


def _cards(f: Feistel, text: str, start: int) -> Iterator[tuple[int, str]]:
    found = _KIND["card"].match(text, start)
    for end in _ends("card", text, start, found.end()) if found else ():
        new = card(f, text[start:end])
        if new is not None:
            yield end, new


def _cut_by(f: Feistel, kind: str, text: str, start: int, end: int) -> str | None:
    """The kind of a likelier value that starts inside ``start`` to ``end``; this reading must not take its beginning."""
    own = _likeness(text[start:end])[:2]
    for at in [m.start() for m in _GROUP_START.finditer(text, start + 1, end)]:
        for to, _ in _cards(f, text, at):
            if to > end if kind != "card" else to >= end and _likeness(text[at:to])[:2] < own:
                return "card"
        if kind == "card":
            for other in ("date", "phone"):
                found = _KIND[other].match(text, at)
                if found and found.end() >= end and KINDS[other][1](f, found.group()) is not None:
                    if found.end() > end:
                        return other
                    if own[1]:
                        return "card"
    return None


def _read(f: Feistel, kind: str, text: str, start: int) -> tuple[int, str] | None:
    """End and pseudonym of the value of this kind at ``start``; shorter readings are tried where a longer one is not valid."""
    found = _KIND[kind].match(text, start)
    if not found:
        return None
    if kind not in _GROUPED:
        new = KINDS[kind][1](f, found.group())
        return None if new is None else (found.end(), new)
    spare = None
    for end in _ends(kind, text, start, found.end()):
        new = KINDS[kind][1](f, text[start:end])
        if new is None:
            continue
        cut = None if kind == "iban" else _cut_by(f, kind, text, start, end)
        if cut is None:
            return end, new
        if cut != "card" and spare is None:
            spare = end, new
    return spare


@functools.lru_cache(maxsize=4)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def rewrite(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """``(text, replaced)``: the text with pseudonyms, and how many of each kind."""
    f, counts, out = _feistel(key), {}, []
    done = at = 0
    while sign := _SIGN.search(text, at):
        at = sign.end()
        for kind, start in _tries(text, sign.start(), done):
            found = _read(f, kind, text, start)
            if found:
                out += [text[done:start], found[1]]
                done = at = found[0]
                counts[kind] = counts.get(kind, 0) + 1
                break
        else:
            if sign.group().isdigit():
                at = _RUN.match(text, at).end()
    return ("".join([*out, text[done:]]) if out else text), counts


def pseudonyms(key: bytes):
    """A function from a text column to ``struct<text, n_replaced, kinds>``; a null text stays null with none replaced."""

    @F.arrow_udf("struct<text: string, n_replaced: long, kinds: string>")
    def run(texts: pa.Array) -> pa.Array:
        new, counts, kinds = [], [], []
        for text in texts:
            text = text.as_py()
            said, found = (None, {}) if text is None else rewrite(text, key)
            new.append(said)
            counts.append(sum(found.values()))
            kinds.append(",".join(f"{k}:{found[k]}" for k in sorted(found)))
        return pa.StructArray.from_arrays(
            [pa.array(new, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["text", "n_replaced", "kinds"]
        )

    return lambda column: run(F.col(column))


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_replaced, kinds)``, one row for each row of ``docs``; ``kinds`` lists ``kind:count`` pairs."""
    common.bounded_batches(docs.sparkSession)
    found = pseudonyms(key)(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("p")).select("doc_id", "p.text", "p.n_replaced", "p.kinds")
