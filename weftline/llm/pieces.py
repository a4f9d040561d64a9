"""SentencePiece encoding and decoding by a table of distinct chunks.

A text is a run of marked words: chunks of one or more whitespace markers and the characters up to the next marker. If
no piece of the model has a marker after another character, no merge crosses from one chunk into the next, so a chunk
has the same pieces wherever it stands. The frequent chunks of the corpus are counted and segmented once, by a Spark
job, into a table of bounded size; the others are segmented once per batch of texts. Ids are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.lineage import cut

MARKER = "▁"
#: The table holds at most so many chunks, none of them longer than so many characters: it fits every worker.
TABLE_CHUNKS = 1 << 17
CHUNK_CHARS = 64
#: What a task learns beside the table, before it starts anew.
LEARNT = 1 << 17
#: Rows whose texts are handled together in a worker.
ROWS = 512
#: Ids that are decoded together in a worker.
IDS = 1 << 17
_CHUNK = re.compile(" +[^ ]*")


def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    """The model, checked for what the chunks rely on."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(MARKER in sp.id_to_piece(i).lstrip(MARKER) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of this model crosses a whitespace marker; its texts can't be cut into chunks")
    if sp.encode("  a ", out_type=str)[-1] != MARKER or sp.encode("a", out_type=str)[0][0] != MARKER:
        raise ValueError("this model doesn't keep white space or doesn't put a marker before a text")
    return sp


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces as markers."""
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


def segment(sp: sentencepiece.SentencePieceProcessor, distinct: list[str]) -> dict[str, bytes]:
    """Ids of every chunk as little-endian 32-bit numbers."""
    found = sp.encode(distinct, num_threads=1) if distinct else []
    ends = np.cumsum([0, *map(len, found)]) * 4
    raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
    table = {c: raw[a:b] for c, a, b in zip(distinct, ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
    # A lone marker; the library takes the empty text for no text at all.
    if "" in table:
        table[""] = np.array([sp.piece_to_id(MARKER)], "<u4").tobytes()
    return table


def _counted(text: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(text):
                if (value := t.as_py()) is not None:
                    seen.update(chunks(value))
            found = [(c, n) for c, n in seen.items() if len(c) <= CHUNK_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["chunk", "n"])

    return count


def chunk_table(docs: DataFrame, model: str, text: str = "text", most: int = TABLE_CHUNKS) -> DataFrame:
    """The frequent chunks of all texts and their ids: chunk, n, ids (binary), at most ``most`` rows.

    Chunks are counted per batch, then over the corpus. Those that occur 2**k times or more are kept, with the
    smallest k for which they are no more than ``most``.
    """
    counts = docs.select(text).mapInArrow(_counted(text), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("n") > 1))
    by_power = counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()  # 64 rows at most
    least, total = 64, 0
    for k, size in sorted(((r["k"], r["count"]) for r in by_power), reverse=True):
        total += size
        if total > most:
            break
        least = k

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            table = segment(sp, batch.column("chunk").to_pylist())
            yield batch.append_column("ids", pa.array(table.values(), pa.binary()))

    return counts.filter(F.col("n") >= F.lit(2.0) ** least).mapInArrow(segmented, "chunk string, n long, ids binary")


def _known(docs: DataFrame, model: str, text: str):
    """The chunk table as a broadcast dictionary; its size is bounded by ``chunk_table``."""
    rows = chunk_table(docs, model, text).select("chunk", "ids").collect()
    return docs.sparkSession.sparkContext.broadcast({r["chunk"]: bytes(r["ids"]) for r in rows})


class Table:
    """Entries that start as ``known``, grow with what is met, and shrink back once that is too much."""

    def __init__(self, known: dict):
        self.known, self.entries = known, dict(known)

    def learn(self, runs: list[list], made) -> None:
        """Have an entry for everything in ``runs``; ``made`` gives the entries of a list of distinct new keys."""
        if len(self.entries) > len(self.known) + LEARNT:
            self.entries = dict(self.known)
        new: set = set()
        for run in runs:
            new.update(set(run).difference(self.entries))
        if new:
            self.entries.update(made(list(new)))

    def joined(self, separator, run: list):
        return separator.join(map(self.entries.__getitem__, run))


def _ids_by_text(sp: sentencepiece.SentencePieceProcessor, table: Table, texts: list[str | None]) -> list[bytes]:
    """Ids of every text; chunks that aren't in the table are segmented once for all these texts."""
    cut_up = [chunks(t or "") for t in texts]
    table.learn(cut_up, lambda new: segment(sp, new))
    return [table.joined(b"", c) for c in cut_up]


def encode(docs: DataFrame, model: str, text: str = "text", ends: bool = True) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and ids_sha256, as the sentencepiece library encodes the texts.

    ``ends`` adds the model's begin and end ids. A null text is encoded as an empty one. ids_sha256 is the SHA-256 of
    the ids as little-endian 32-bit numbers. Columns of these names are replaced, all others pass through; rows that
    repeat get equal ids, and an empty table gives no rows. Only counts of chunks are shuffled.
    """
    docs = docs.drop("ids", "n_tokens", "ids_sha256")
    known = _known(docs, model, text)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table = Table(known.value)
        first, last = (np.array([i], "<u4").tobytes() if ends else b"" for i in (sp.bos_id(), sp.eos_id()))
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = [first + body + last for body in _ids_by_text(sp, table, batch.column(text).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                ],
                names=[*batch.schema.names, "ids", "n_tokens", "ids_sha256"],
            )

    return docs.mapInArrow(encoded, schema)


def count_tokens(docs: DataFrame, model: str, text: str = "text", ends: bool = True) -> DataFrame:
    """``docs`` without the texts and with n_tokens, the length of what :func:`encode` gives."""
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]
    known = _known(docs, model, text)
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table = Table(known.value)
        extra = 2 if ends else 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = _ids_by_text(sp, table, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array([len(x) // 4 + extra for x in ids], pa.int64())], names=[*rest, "n_tokens"]
            )

    return docs.mapInArrow(counted, schema)


class PieceTexts:
    """The bytes that every piece stands for, one after another, with where each begins and how long it is."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor):
        self.sp = sp
        pieces = range(sp.get_piece_size())
        self.marked = np.array([sp.id_to_piece(i)[:1] == MARKER for i in pieces])
        self.control = np.array([sp.is_control(i) for i in pieces])
        parts = [self._bytes(sp, i) for i in pieces]
        self.high = np.array([sp.is_byte(i) and parts[i] >= b"\x80" for i in pieces])
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def _bytes(sp: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
        if sp.is_control(i):
            return b""
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[3:5], 16)])
        return " \u2047 ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARKER, " ").encode()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str] | pa.Array:
        """Texts of the runs of ``ids`` that end before ``ends``; the first marker of a text stands for nothing.

        Bytes from 0x80 on may not make up characters; texts with any are left to the library if they don't.
        """
        known = ~self.control[ids]
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        ids = ids[known]
        begins = np.concatenate([[0], ends[:-1]])
        starts, sizes = self.starts[ids], self.sizes[ids]
        first = begins[begins < ends]
        first = first[self.marked[ids[first]]]
        starts[first] += 1
        sizes[first] -= 1
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self.data[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        offsets = np.concatenate([[0], upto[ends]])
        doubtful = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.high[ids])])[np.concatenate([[0], ends])]))
        wrong = [k for k in doubtful.tolist() if not _is_text(data[offsets[k] : offsets[k + 1]].tobytes())]
        if not wrong and offsets[-1] < 2**31:
            return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        whole = data.tobytes()
        texts = [None if k in wrong else whole[offsets[k] : offsets[k + 1]].decode() for k in range(len(ends))]
        for k in wrong:
            texts[k] = self.sp.decode(ids[begins[k] : ends[k]].tolist())
        return texts


def _by_ids(batch: pa.RecordBatch, ids: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``IDS`` ids; a longer row is a part of its own."""
    upto = np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(upto // IDS)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with ``text``, as the sentencepiece library decodes ``ids``, an array of int; null ids give a null.

    Every piece's text is looked up once per task, and the texts of all pieces of a batch are joined by position at
    once. Ids of control pieces stand for nothing. ``ids`` itself is dropped.
    """
    rest = [c for c in docs.columns if c not in (ids, text)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(text, T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTexts(processor(model))
        for batch in (part for b in batches for part in _by_ids(b, ids)):
            column = batch.column(ids)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
            if column.null_count:
                texts = [t if ok else None for t, ok in zip(pa.array(texts, pa.string()).to_pylist(), column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, text])

    return docs.mapInArrow(decoded, schema)
