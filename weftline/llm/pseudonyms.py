"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10
ROWS = 1024
#: Letters and digits of an address's local part, in the order of their numbers.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Characters of the local parts that are all on one ring.
RING = 2
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, domain: str, size: int, step: int, half: int) -> int:
        data = f"{domain}|{size}|{step}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=16).digest(), "big")

    def permute(self, value: int, size: int, domain: str) -> int:
        """The place of ``value`` in the permutation of range(size) that belongs to ``domain``.

        The halves of a number below a * b, a and b near the root of ``size``, are mixed in turn; numbers that fall
        outside are permuted again, so they end inside and no two end in one place.
        """
        if size < 2:
            return value
        b = int(size**0.5) + 1
        a = -(-size // b)
        while True:
            left, right = divmod(value, b)
            for step in range(ROUNDS):
                if step % 2:
                    right = (right + self._round(domain, size, step, left)) % b
                else:
                    left = (left + self._round(domain, size, step, right)) % a
            value = left * b + right
            if value < size:
                return value

    def next_on_ring(self, value: int, size: int, domain: str) -> int:
        """What follows ``value`` on a keyed ring of all of range(size): a permutation too, and one that leaves nothing in its place."""
        ring = sorted(range(size), key=lambda k: (self._round(domain, size, -1, k), k))
        return ring[(ring.index(value) + 1) % size]

    def among(self, value: int, size: int, domain: str, valid: Callable[[int], bool]) -> int:
        """Permute a valid number among the valid ones below ``size``."""
        while True:
            value = self.permute(value, size, domain)
            if valid(value):
                return value


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(f: Feistel, found: str) -> str | None:
    digits = _digits(found)
    if not (13 <= len(digits) <= 19 and luhn(digits)) or len(set(digits)) == 1:
        return None
    body = digits[:-1]
    new = str(f.permute(int(body), 10 ** len(body), f"card{len(body)}")).zfill(len(body))
    return _refill(found, next(new + c for c in "0123456789" if luhn(new + c)))


def _north_american(number: int) -> bool:
    area, exchange = divmod(number // 10_000, 1000)
    return 200 <= area <= 999 and 200 <= exchange <= 999


def phone(f: Feistel, found: str) -> str | None:
    """Numbers that the numbering plan allows stay allowed; others in a telephone number's form stay as they are not."""
    digits = _digits(found)
    number = int(digits[-10:])
    allowed = _north_american(number)
    new = f.among(number, 10**10, "phone", lambda x: _north_american(x) == allowed and x >= 10**9)
    return _refill(found, digits[:-10] + str(new)) if number >= 10**9 else None


def _social(number: int) -> bool:
    area, group, serial = number // 1_000_000, number // 10_000 % 100, number % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def social(f: Feistel, found: str) -> str | None:
    number = int(_digits(found))
    return _refill(found, str(f.among(number, 10**9, "social", _social)).zfill(9)) if _social(number) else None


def ipv4(f: Feistel, found: str) -> str | None:
    if any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, f.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ipv4").to_bytes(4, "big")))


def email(f: Feistel, found: str) -> str | None:
    """The local part keeps its length, its marks and the places of capitals; the domain stays. Case tells none apart.

    A permutation of few names would leave some as they are; those of one or two characters move along a ring.
    """
    local, _, domain = found.lower().rpartition("@")
    inner = [c for c in local if c in ALPHABET]
    number = 0
    for c in inner:
        number = number * len(ALPHABET) + ALPHABET.index(c)
    place = f.next_on_ring if len(inner) <= RING else f.permute
    number = place(number, len(ALPHABET) ** len(inner), f"email{len(inner)}@{domain}")
    new = []
    for _ in inner:
        number, k = divmod(number, len(ALPHABET))
        new.append(ALPHABET[k])
    it = reversed(new)
    name = (next(it) if c in ALPHABET else c for c in local)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(name, found, strict=False)) + found[found.rindex("@") :]


def _iban_check(country: str, body: str) -> str:
    value = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - value % 97:02d}"


def iban(f: Feistel, found: str) -> str | None:
    """The country and all letters stay; the digits after the check digits are permuted and these made anew."""
    plain = found.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if _iban_check(country, body) != check:
        return None
    digits = _digits(body)
    body = _refill(body, str(f.permute(int(digits or 0), 10 ** len(digits), f"iban{country}{len(digits)}")).zfill(len(digits)))
    it = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(it) for c in found)


def _date(f: Feistel, year: str, month: str, day: str) -> tuple[str, str, str] | None:
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + f.permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    return f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"


def date_iso(f: Feistel, found: str) -> str | None:
    new = _date(f, found[:4], found[5:7], found[8:])
    return new and found[4].join(new)


def date_day_first(f: Feistel, found: str) -> str | None:
    new = _date(f, found[6:], found[3:5], found[:2])
    return new and ".".join(reversed(new))


def date_month_first(f: Feistel, found: str) -> str | None:
    new = _date(f, found[6:], found[:2], found[3:5])
    return new and f"{new[1]}/{new[2]}/{new[0]}"


#: Kind, pattern of a candidate, and what validates and replaces it; earlier kinds go first.
KINDS: tuple[tuple[str, str, Callable[[Feistel, str], str | None]], ...] = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ipv4),
    ("date", r"(?<![\d/.-])\d{4}([-/])\d{2}\1\d{2}(?![\d/-])", date_iso),
    ("date", r"(?<![\d/.-])\d{2}\.\d{2}\.\d{4}(?!\d)", date_day_first),
    ("date", r"(?<![\d/.-])\d{2}/\d{2}/\d{4}(?![\d/])", date_month_first),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("phone", r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", phone),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
)


def _numbered(pattern: str, number: int) -> str:
    """The pattern as a named group of one alternation, with its own back reference named."""
    named = pattern.replace("([-/])", f"(?P<s{number}>[-/])").replace(r"\1", f"(?P=s{number})")
    return f"(?P<k{number}>{named})"


#: An address starts with a letter, all else with a digit, "+", "(" or a capital: one pass finds all kinds.
FINDER = re.compile("|".join(_numbered(p, k) for k, (_, p, _) in enumerate(KINDS)), re.ASCII)
#: A text without a digit or an at sign has none of the kinds.
HINT = re.compile(r"[0-9@]")


def pseudonymise_text(f: Callable[[int, str], str | None], text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, end) of the values in it as it was."""
    spans: list[tuple[str, int, int]] = []
    if not HINT.search(text):
        return text, spans

    parts, done, at = [], 0, 0
    while m := FINDER.search(text, at):
        number = int(next(name for name, value in m.groupdict().items() if value is not None and name[0] == "k")[1:])
        new = f(number, m[0])
        if new is None:
            # Another kind may still hold here: the next candidates begin one character on.
            at = m.start() + 1
            continue
        spans.append((KINDS[number][0], m.start(), m.end()))
        parts += [text[done : m.start()], new]
        done = at = m.end()
    return "".join([*parts, text[done:]]), spans


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and n_private (values replaced) and private_spans (kind, start, end).

    A candidate must pass its kind's check: calendar, Luhn, mod 97, octets, social number ranges, or the form of a
    telephone number. It is then permuted with the key among the values that pass the same check in the same format; so equal values have equal pseudonyms in
    all documents, different values different ones, and marks and (but for IP addresses) lengths stay. Addresses keep
    their domain, and card numbers and IBANs get check digits that hold. A permutation may have a value stay in its place, with odds of one in
    as many values as the format has, 46,656 or more. Octets with leading zeros are no address. Spans count characters of the text as it was.

    A null text stays null with n_private 0; empty texts, repeated rows and extra columns pass through, except
    that columns named n_private and private_spans are replaced. An empty table gives no rows. Nothing is shuffled.
    """
    docs = docs.drop("n_private", "private_spans")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_private", T.LongType()), T.StructField("private_spans", T.ArrayType(span))])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(hashlib.sha256(key.encode()).digest())

        @lru_cache(maxsize=50_000)
        def pseudonym(number: int, found: str) -> str | None:
            return KINDS[number][2](feistel, found)

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts, spans = [], []
            for value in batch.column(text).to_pylist():
                new, found = (None, []) if value is None else pseudonymise_text(pseudonym, value)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in batch.schema.names]
            columns += [pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_private", "private_spans"])

    return docs.mapInArrow(replaced, schema)
