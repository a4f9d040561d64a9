"""WARC archives: written by Spark's text writer, read back by a Python data source.

A record is a block of header lines, an empty line and the content, ended by an empty line. The text writer's rows are
records and its line separator is that end, so archives are written in parallel, with Spark's commit protocol, to any
file system that Spark knows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from weftline.plans.lineage import checkpoint_dir
from weftline.plans.spread import join_spread

END = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives that one task reads, and of payloads that it hands on at once.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32, as WARC headers give it: 160 bits are 32 digits of 5 bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def warc_records(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One WARC record per row of ``pages`` in the column ``value``.

    Of pages with one payload of at least ``least_bytes``, the one with the smallest id is written as a response and
    the others as revisits that refer to it; all smaller ones are responses. A null payload is empty, a null url is
    left out, and blanks in a url are percent-encoded. A page without an id is a response that names none. Rows that
    repeat are records like others, and pages that share an id without sharing a payload are records of their own. Which
    payloads repeat is found on digests; the rows of one digest are spread over tasks.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"), base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    repeated = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("size"))
    repeated = repeated.filter((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("digest", "first")
    rows = join_spread(rows, repeated, ["digest"], F.coalesce("url", F.col("id").cast("string"), F.lit("")))
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    where = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"\s", "%20")
    head = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(F.lit(HTTP_HEAD))
    content = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    name = F.coalesce(F.concat(F.lit("page:"), F.col("id").cast("string")), F.concat(F.lit("payload:"), F.col("digest")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:"), name, F.lit(">")),
        F.lit("WARC-Date: 2024-01-31T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), where),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
        F.lit(""),
    ]
    # concat_ws leaves out the lines that are null.
    return rows.select(F.concat_ws(END, *lines, content).alias("value"))


def write_warc(records: DataFrame, path: str | None = None) -> str:
    """Write records as gzipped archives and return their folder, a new one in the shared folder if none is given."""
    path = path or f"{checkpoint_dir(records.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records.select("value").write.option("lineSep", END + END).option("compression", "gzip").text(path)
    return path


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``, as :class:`WarcSource` gives them.

    Files are listed by Spark, whose driver plans one name per archive as for any other source; filters on header
    columns are pushed into the source, for which the session's ``spark.sql.python.filterPushdown.enabled`` is set.
    Without ``payload`` contents are skipped. Archives may be one gzip stream or a gzip member per record.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = [(r["path"], r["length"]) for r in listed.collect() if r["length"]]  # one name per archive, as Spark itself plans
    return spark.read.format("warc").option("files", json.dumps(files)).option("payload", str(payload).lower()).load()


class WarcSource(DataSource):
    """``spark.read.format("warc")`` with the options ``files`` (JSON list of path and size) and ``payload``.

    The payload is the content after the HTTP head; it is null where it isn't wanted. ``headers`` holds all header
    lines by their lower-case names.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "warc_type string, record_id string, target_uri string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(json.loads(self.options["files"]), self.options.get("payload", "true") == "true")


#: Columns and the header lines they come from.
FIELDS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


@dataclass
class Archives(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Plans archives by size, tests pushed predicates on the header alone and skips what they reject."""

    def __init__(self, files: list[tuple[str, int]], payload: bool):
        self.files, self.payload, self.tests = files, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (test := predicate(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Archives]:
        parts, held, size = [], [], 0
        for path, length in sorted(self.files):
            if held and size + length > SPLIT_BYTES:
                parts.append(Archives(held))
                held, size = [], 0
            held.append(path)
            size += length
        return [*parts, Archives(held)] if held else parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            for headers, take in records(path):
                values = [headers.get(name) for name in FIELDS.values()]
                row = dict(zip(FIELDS, values, strict=True))
                if not all(field in row and test(row[field]) for field, test in self.tests):
                    continue
                body = payload_of(take()) if self.payload else None
                rows.append((*values, int(headers["content-length"]), list(headers.items()), body))
                size += len(body or b"") + 200
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [*FIELDS, "content_length", "headers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def predicate(f: Filter) -> tuple[str, Callable[[str | None], bool]] | None:
    """A header column and a test of its value, for the filters that headers answer."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in FIELDS:
        return None
    field = f.attribute[0]
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return field, lambda v: v == f.value
    if isinstance(f, In):
        return field, lambda v: v in f.value
    if isinstance(f, IsNotNull):
        return field, lambda v: v is not None
    if isinstance(f, StringStartsWith):
        return field, lambda v: v is not None and v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return field, lambda v: v is not None and v.endswith(f.value)
    if isinstance(f, StringContains):
        return field, lambda v: v is not None and f.value in v
    return None


def payload_of(content: bytes) -> bytes:
    """What follows the HTTP head."""
    return content.partition(b"\r\n\r\n")[2]


def records(path: str) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """Headers of every record and a function that reads its content; content not read is skipped."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with system.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None) as stream:
        held = bytearray()

        def fill(n: int) -> bool:
            while len(held) < n:
                if not (more := stream.read(max(READ_BYTES, n - len(held)))):
                    return False
                held.extend(more)
            return True

        def drop(n: int) -> None:
            """Pass over ``n`` bytes without gathering them."""
            while n > len(held):
                n -= len(held)
                held.clear()
                if not fill(1):
                    raise ValueError(f"{path} ends inside a record")
            del held[:n]

        while True:
            searched = 0
            while (end := held.find(b"\r\n\r\n", searched)) < 0:
                searched = max(0, len(held) - 3)
                if not fill(len(held) + 1):
                    if held.strip():
                        raise ValueError(f"{path} ends inside a header")
                    return
            lines = held[:end].decode("utf-8").split("\r\n")
            del held[: end + 4]
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{path} has no WARC record where one should begin")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            length = int(headers["content-length"])
            left = [length]

            def take() -> bytes:
                if not fill(length):  # noqa: B023
                    raise ValueError(f"{path} ends inside a record")
                body = bytes(held[:length])  # noqa: B023
                del held[:length]  # noqa: B023
                left[0] = 0  # noqa: B023
                return body

            yield headers, take
            drop(left[0])
            if fill(4):
                del held[:4]


def page_of(reference: Column) -> Column:
    """The page id in a record id that :func:`warc_records` made."""
    return F.nullif(F.regexp_extract(reference, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record of archives that :func:`warc_records` made: page_id, payload, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, whose length and digest are computed anew; revisits are read without
    contents. Their header has the id of the response they refer to and the digest of its payload: both must agree, so
    pages that share an id are told apart. The payload of a revisit is null.
    """
    found = read_warc(spark, path).filter(F.col("warc_type") == "response")
    responses = found.select(
        page_of(F.col("record_id")).alias("page_id"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read_warc(spark, path, payload=False).filter(F.col("warc_type") == "revisit")
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    revisits = revisits.select(page_of(F.col("record_id")).alias("page_id"), page_of(F.col("refers_to")).alias("refers_to"), stated.alias("payload_digest"))
    known = responses.filter("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    resolved = join_spread(revisits, known, ["refers_to", "payload_digest"], F.coalesce("page_id", F.lit(0)))
    resolved = resolved.select("page_id", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(resolved)
