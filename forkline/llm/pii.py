"""Personal data replaced by keyed pseudonyms of the same format.

Values are found by patterns and then validated: card numbers by their check digit, IBANs by
theirs, addresses by their octets, social security numbers by their ranges, dates by the
calendar. What does not validate stays as it is. A valid value is mapped to its rank among
all values of its format (same kind, same length, same kinds of characters, same separators),
the rank is permuted by a Feistel network under a key, and the permuted rank is written in
the same format, with check digits made anew. So texts keep their length, pseudonyms are
valid values, equal values stay equal in all documents, and different ones stay different.

The network has eight rounds of keyed BLAKE2 over an even number of bits and walks on while it
leaves the format's range, which makes it a permutation E of that range. The pseudonym of x
is E'(E(x) + 1), E' the inverse: still a keyed permutation, and no value is its own pseudonym.

Kinds: email (its local part), secret (quoted hexadecimal credentials), iban, card, ip, ssn,
date, phone (all digits but the country code). What one kind has taken is out of the reach of
those named after it.

Nulls stay null, empty texts empty. Repeated rows change alike. An empty table gives an empty
result. The work is one pass over each text, and no row needs another.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from calendar import isleap
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ROUNDS = 8
#: For tests and demonstrations. Production passes a key of its own, kept outside the code.
KEY = b"forkline demonstration key"
#: Days of these years and all others are permuted apart, so that usual dates stay usual.
USUAL_YEARS = range(1900, 2100)


def _round(key: bytes, tweak: bytes, n: int, half: int, bits: int) -> int:
    size = (bits + 7) // 8
    value = blake2b(n.to_bytes(1, "big") + half.to_bytes(size, "big"), key=key[:64], digest_size=min(64, size + 8), person=tweak[:16].ljust(16, b"\0")).digest()
    return int.from_bytes(value, "big") & ((1 << bits) - 1)


def _feistel(key: bytes, tweak: bytes, value: int, size: int, order: range) -> int:
    """A permutation of range(size), or its inverse with the rounds in reverse order."""
    bits = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    forward = order.step > 0
    while True:
        left, right = value >> bits, value & mask
        for n in order:
            if forward:
                left, right = right, left ^ _round(key, tweak, n, right, bits)
            else:
                left, right = right ^ _round(key, tweak, n, left, bits), left
        value = left << bits | right
        if value < size:
            return value


def permute(key: bytes, tweak: bytes, rank: int, size: int) -> int:
    """A keyed permutation of range(size) that leaves no rank where it is."""
    if size < 2:
        return rank
    there = _feistel(key, tweak, rank, size, range(ROUNDS))
    return _feistel(key, tweak, (there + 1) % size, size, range(ROUNDS - 1, -1, -1))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _spell(key: bytes, tweak: bytes, text: str, alphabets: tuple[str, ...] = (_LOWER, _UPPER, _DIGITS)) -> str:
    """Every character replaced within its alphabet, all of them by one permutation."""
    places = [next((a for a in alphabets if c in a), None) for c in text]
    rank, size = 0, 1
    for c, a in zip(text, places):
        if a:
            rank, size = rank * len(a) + a.index(c), size * len(a)
    rank = permute(key, tweak, rank, size)
    out = []
    for c, a in zip(reversed(text), reversed(places)):
        if a:
            rank, at = divmod(rank, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced one after another."""
    each = iter(digits)
    return "".join(next(each) if c in _DIGITS else c for c in pattern)


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(key: bytes, m: re.Match) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    return f"{_spell(key, b'email', local)}@{domain}"


def _secret(key: bytes, m: re.Match) -> str | None:
    upper = m["hex"] != m["hex"].lower()
    return m["name"] + _spell(key, b"secret", m["hex"], ("0123456789ABCDEF",) if upper else ("0123456789abcdef",))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban_valid(plain: str) -> bool:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban_matches(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """What is valid, the longest first at each place: upper-case words may follow an IBAN.

    A shorter stop must be the end of a word. Where nothing is valid the search goes on at
    the next word, since an IBAN can stand right behind what looks like the start of one.
    """
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        stop = m.end()
        while m:
            if _iban_valid(m[0].replace(" ", "")):
                yield m
                at = m.end()
                break
            stop = text.rfind(" ", m.start(), stop)
            m = pattern.fullmatch(text, m.start(), stop) if stop > 0 else None


def _iban(key: bytes, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    if not _iban_valid(plain):
        return None
    rest = _spell(key, b"iban" + plain[:2].encode(), plain[4:])
    made = iter(f"{plain[:2]}{_iban_check(plain[:2], rest):02d}{rest}")
    return "".join(c if c == " " else next(made) for c in m[0])


def _card(key: bytes, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not luhn(digits) or not digits.strip("0"):
        return None
    size = 10 ** (len(digits) - 1)
    body = f"{permute(key, b'card', int(digits[:-1]), size):0{len(digits) - 1}d}"
    return _refill(m[0], body + next(d for d in _DIGITS if luhn(body + d)))


#: How many octets have one, two and three digits, and the first of each.
_OCTETS = {1: (10, 0), 2: (90, 10), 3: (156, 100)}


def _ip(key: bytes, m: re.Match) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    rank, size = 0, 1
    for p in parts:
        count, first = _OCTETS[len(p)]
        rank, size = rank * count + int(p) - first, size * count
    rank = permute(key, b"ip", rank, size)
    out = []
    for p in reversed(parts):
        count, first = _OCTETS[len(p)]
        rank, at = divmod(rank, count)
        out.append(str(at + first))
    return ".".join(reversed(out))


#: Area numbers but 000, 666 and 900 to 999.
_AREAS = [n for n in range(1, 900) if n != 666]


def _ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = (int(p) for p in m[0].split("-"))
    if area == 666 or not 0 < area < 900 or not group or not serial:
        return None
    rank = (_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(permute(key, b"ssn", rank, len(_AREAS) * 99 * 9999), 9999)
    area, group = divmod(rank, 99)
    return f"{_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


@cache
def _in_year(leap: bool, widths: tuple[int, int]) -> list[tuple[int, int]]:
    """Months and days of a year that are written with these widths, in order."""
    days = (date.fromordinal(date(2000 if leap else 2001, 1, 1).toordinal() + k) for k in range(366 if leap else 365))
    return [(d.month, d.day) for d in days if (widths[0] == 2 or d.month < 10) and (widths[1] == 2 or d.day < 10)]


@cache
def _years(usual: bool, widths: tuple[int, int]) -> tuple[list[int], list[int]]:
    """The years of a part, and how many of its days lie before each and before the end."""
    years = [y for y in range(date.min.year, date.max.year + 1) if (y in USUAL_YEARS) == usual]
    before = [0]
    for y in years:
        before.append(before[-1] + len(_in_year(isleap(y), widths)))
    return years, before


def _date(key: bytes, m: re.Match) -> str | None:
    mark = re.search(r"\D", m[0])[0]
    parts = m[0].split(mark)
    for order in {"-": ("ymd",), ".": ("dmy",), "/": ("mdy", "dmy")}[mark]:
        at = dict(zip(order, map(int, parts)))
        try:
            day = date(at["y"], at["m"], at["d"])
        except ValueError:
            continue
        width = dict(zip(order, map(len, parts)))
        widths = (width["m"], width["d"])
        years, before = _years(day.year in USUAL_YEARS, widths)
        rank = before[bisect_left(years, day.year)] + bisect_left(_in_year(isleap(day.year), widths), (day.month, day.day))
        rank = permute(key, b"date", rank, before[-1])
        k = bisect_right(before, rank) - 1
        month, day_of = _in_year(isleap(years[k]), widths)[rank - before[k]]
        made = {"y": years[k], "m": month, "d": day_of}
        return mark.join(f"{made[f]:0{width[f]}d}" for f in order)
    return None


def _phone(key: bytes, m: re.Match) -> str | None:
    """The country code is what follows the plus sign up to a separator, or one digit."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", m[0])[0]
    rest = m[0][len(code) :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) + len(code) - (code != "") <= 15:
        return None
    return code + _refill(rest, f"{permute(key, b'phone', int(digits), 10 ** len(digits)):0{len(digits)}d}")


#: Kind, pattern, and what makes a pseudonym of a match or returns None if it is not valid.
KINDS: tuple[tuple[str, re.Pattern, Callable[[bytes, re.Match], str | None]], ...] = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"), _email),
    ("secret", re.compile(r"(?P<name>(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']? ?[=:] ?[\"'])(?P<hex>[0-9a-f]{16,128}|[0-9A-F]{16,128})(?=[\"'])"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<!\d)(?<!\d[.,-])(?:\d{13,19}|\d{4}(?P<a>[ -])\d{4}(?P=a)\d{4}(?P=a)\d{1,7}|\d{4}(?P<b>[ -])\d{6}(?P=b)\d{5})(?![\d-])(?![.,]\d)"), _card),
    ("ip", re.compile(r"(?<!\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?![\d])(?!\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("date", re.compile(r"(?<![\d/-])(?<!\d\.)(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-])(?!\.\d)"), _date),
    ("phone", re.compile(r"(?<![\d+])(?<!\d[.-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])(?!\.\d)"), _phone),
)
#: Stands in the place of what is taken while other kinds are looked for.
TAKEN = "\x00"
_MAYBE = re.compile(r"[0-9@]")
_SECRET = re.compile(r"(?i)token|secret|passw|key")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and where they are: kind, start, stop (in characters)."""
    if not text or not _MAYBE.search(text) and not _SECRET.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    rest = text
    for kind, pattern, make in KINDS:
        matches = _iban_matches(pattern, rest) if kind == "iban" else pattern.finditer(rest)
        found = [(m.start(), m.end(), kind, made) for m in matches if (made := make(key, m)) is not None]
        if found:
            taken += found
            rest = _put(rest, [(start, stop, TAKEN * (stop - start)) for start, stop, _, _ in found])
    taken.sort()
    return _put(text, [(start, stop, made) for start, stop, _, made in taken]), [(kind, start, stop) for start, stop, kind, _ in taken]


def _put(text: str, values: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, value in values:
        out += [text[at:start], value]
        at = stop
    return "".join([*out, text[at:]])


def pseudonymised(text: Column, key: bytes) -> Column:
    """text and spans (kind, start, stop) as one struct; ``key`` is the secret of the corpus."""

    @F.pandas_udf("struct<text:string,spans:array<struct<kind:string,start:int,stop:int>>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [pseudonymise(t, key) for t in batch]
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in s] for _, s in made]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in made], dtype=object), "spans": pd.Series(spans, dtype=object)})

    return of(text)


def pseudonym_table(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the changed text and its spans."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), pseudonymised(F.col(text), key).alias("made"))
    return rows.select("doc_id", "made.text", "made.spans")


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text changed under the secret ``key``."""

    @F.pandas_udf(StringType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([pseudonymise(t, key)[0] for t in batch], dtype=object)

    return docs.withColumn(text, of(F.col(text)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonym_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",")
    return found.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_values"), kinds.alias("kinds"))
