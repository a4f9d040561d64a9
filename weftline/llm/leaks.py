"""Secret scans by corpus-wide ownership frequency.

Patterns find candidates. Whether one is a live credential shows in who else holds it: a value in the documents of many
owners or repositories is an example that was copied around, one that belongs to a single owner and looks random isn't.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import cut
from weftline.plans.spread import join_spread

#: Kinds in the order of the spans that begin at one place; ``live`` marks values that ownership shows to be live.
KINDS = ("assign", "access", "hex", "live")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
VALUE_CHARS = 6
#: A longer run is one match of the shortest kind, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further candidates: unbroken runs as credentials of many services are.
LOOSE = re.compile(r"[A-Za-z0-9_-]{20,}")
#: A value that can be live has this many characters and bits a character, letters and digits, and none of the words of examples.
LIVE_CHARS = 16
LIVE_BITS = 3.0
EXAMPLES = ("example", "changeme", "placeholder", "dummy", "sample", "your", "xxxx", "1234567", "abcdef0")
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
ROWS = 1024


def looks_live(value: str) -> bool:
    """Whether a value has the length, the mixture and the entropy of a drawn credential."""
    low = value.lower()
    if len(value) < LIVE_CHARS or not any("0" <= c <= "9" for c in low) or not any("a" <= c <= "z" for c in low) or any(e in low for e in EXAMPLES):
        return False
    return sum(-k / len(value) * math.log2(k / len(value)) for k in Counter(value).values()) >= LIVE_BITS


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the three patterns, in order."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_CHARS] if any(k in low for k in KEYWORDS) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all values that look live, wherever a pattern has them; each once."""
    low = text.lower()
    found = {m.span(2) for m in ASSIGN.finditer(text)} if any(k in low for k in KEYWORDS) else set()
    found |= {m.span() for pattern in (ACCESS, HEX, LOOSE) for m in pattern.finditer(text)}
    return sorted(s for s in found if looks_live(text[s[0] : s[1]]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_VALUES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))
_SHAPE = "base_sha256 string, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,value:binary>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        digests, spans, values = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            values.append([{"start": s, "end": e, "value": hashlib.blake2b(text[s:e].encode(), digest_size=16).digest()} for s, e in candidates(text)])
        columns = [*(batch.column(c) for c in ("row", "doc_id", "owner", "repository")), pa.array(digests), pa.array(spans, _SPANS), pa.array(values, _VALUES)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "owner", "repository", "base_sha256", "base", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners and n_repositories of candidates (value, owner, repository); every holder counts once."""
    held = found.select("value", "owner", "repository").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied.

    ``spans`` lists the matches of the three patterns and, as ``live``, the values that look random and that no more
    than ``most_owners`` owners in ``most_repositories`` repositories hold; n_copied counts those that more of them
    hold. Only digests of candidates leave a task, never values or texts; holders are counted after they are made
    distinct where they stand, and a value that everybody holds is spread over tasks.

    A null text is empty; a null owner or repository is one of its own; a repository belongs to its owner. Rows that
    repeat, and rows without an id, are rows like any other; very long texts are scanned whole; spans that begin at
    one place stand by kind. An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col(text).alias("text"),
    )
    kept = docs.schema[doc_id].dataType.simpleString()
    rows = cut(rows.mapInArrow(_scanned, f"row long, doc_id {kept}, owner string, repository string, {_SHAPE}"))
    found = rows.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    held = ownership(found).select("value", ((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)).alias("live"))
    judged = join_spread(found, held, ["value"], "row", "inner")
    live = F.struct("start", F.lit(KINDS.index("live")).alias("kind"), "end")
    # A document's own values, as many as its text has.
    by_row = judged.groupBy("row").agg(F.collect_list(F.when(F.col("live"), live)).alias("live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    out = rows.join(by_row, "row", "left").withColumn("live", F.coalesce("live", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    names = F.array(*map(F.lit, KINDS))
    label = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", "live")), label), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, "base_sha256", spans.alias("spans"), F.size("live").cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"))
