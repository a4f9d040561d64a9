"""Functions that Spark's built-ins can't express, over Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

M32 = (1 << 32) - 1


def jaro(a: str, b: str) -> float:
    """Jaro similarity: characters in common within half the longer length, and those out of order."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str | None, b: str | None, limit: int = 5000) -> float:
    """Jaro similarity raised by up to four equal first characters; 0 if a text is missing or empty."""
    if not a or not b:
        return 0.0
    a, b = a[:limit], b[:limit]
    score = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + prefix * 0.1 * (1 - score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_text(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def unescape_html(c: pd.Series) -> pd.Series:
    """All entities, also numeric ones."""
    return c.map(html.unescape, na_action="ignore")


def feature_hashes(features: list[str]) -> np.ndarray:
    """64-bit hashes of ASCII features: two 32-bit multiplicative hashes of the characters, one place of all features at a time."""
    units = np.frombuffer("\n".join([*features, ""]).encode("ascii"), np.uint8)
    ends = np.flatnonzero(units == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts
    # The longest first, so those that have a place are a run.
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    low, high = np.full(len(features), 0xDEADBEEF, np.uint64), np.full(len(features), 0x41C6CE57, np.uint64)
    mask = np.uint64(M32)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, side="left"))
        unit = units[starts[:n] + place].astype(np.uint64)
        low[:n] = (low[:n] ^ unit) * np.uint64(2654435761) & mask
        high[:n] = (high[:n] ^ unit) * np.uint64(1597334677) & mask
    low = (low ^ low >> np.uint64(16)) * np.uint64(2246822507)
    high = (high ^ high >> np.uint64(16)) * np.uint64(3266489909)
    hashes = np.empty(len(features), np.uint64)
    hashes[order] = ((high ^ high >> np.uint64(13)) & mask) << np.uint64(32) | (low ^ low >> np.uint64(13)) & mask
    return hashes


_WORD = re.compile("[a-z0-9_]+")
#: Characters of texts that are hashed together.
TOGETHER = 1 << 18


def _features(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return [" ".join(three) for three in zip(words, words[1:], words[2:], strict=False)] + [w for w in words if len(w) >= 4]


def simhashes(texts: Iterable[str | None]) -> Iterator[int | None]:
    """SimHashes of three-word shingles and of words of four letters or more, as signed numbers; of several texts at once."""
    held: list[list[str] | None] = []
    size = 0

    def done() -> Iterator[int | None]:
        hashes = feature_hashes([f for own in held for f in own or []]).astype(">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        at = 0
        for own in held:
            n = len(own or [])
            ones = bits[at : at + n].sum(axis=0, dtype=np.int64)
            at += n
            yield None if own is None else int(np.packbits(2 * ones > n).view(">i8")[0])

    for text in texts:
        held.append(None if text is None else _features(text))
        size += len(text or "")
        if size >= TOGETHER:
            yield from done()
            held, size = [], 0
    yield from done()


def simhash_text(text: str | None) -> int | None:
    return next(simhashes([text]))


@F.pandas_udf(T.LongType())
def simhash(c: pd.Series) -> pd.Series:
    return pd.Series(list(simhashes(c)), dtype="Int64")


def fnv1a(text: str) -> int:
    """FNV-1a with 32-bit wrapping multiplication, over UTF-16 code units."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = (h ^ (units[k] | units[k + 1] << 8)) * 0x01000193 & M32
    return h


def fnv1a_float(text: str) -> int:
    """The variant that multiplies in double precision and only then cuts to 32 bits, so large products are rounded."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        mixed = (h ^ (units[k] | units[k + 1] << 8)) & M32
        signed = mixed - (1 << 32) if mixed >= 1 << 31 else mixed
        h = int(float(signed) * float(0x01000193)) & M32
    return h


@F.pandas_udf(T.LongType())
def fnv1a_hash(c: pd.Series) -> pd.Series:
    return c.map(fnv1a, na_action="ignore").astype("Int64")


def mulberry32(seed: int):
    """A seeded generator of numbers from 0 to 1."""
    state = seed & M32
    while True:
        state = state + 0x6D2B79F5 & M32
        t = (state ^ state >> 15) * (state | 1) & M32
        t = (t + ((t ^ t >> 7) * (t | 61) & M32) & M32) ^ t
        yield ((t ^ t >> 14) & M32) / 2**32


def pick_variant(key: str, variants: int, recent: tuple[int, ...] = ()) -> int:
    """The variant that a key's hash names, or the next one that wasn't used recently."""
    first = fnv1a(key) % variants
    order = [(first + k) % variants for k in range(variants)]
    return next((k for k in order if k not in recent), first)
