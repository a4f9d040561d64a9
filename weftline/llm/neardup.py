"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A sketch is made of several samples. Each takes the ``PER_SAMPLE`` pairs of words that come first under its own hash
of pair and occurrence, and keeps them in the order of the text. Two texts agree in a sample if it drew the same pairs
in the same order, with odds near the power ``PER_SAMPLE`` of the share of pairs they have in common and in order.

Texts that agree in a sample are aligned word by word. Their similarity is twice the words that the alignment matches
over the words of both: one changed word in twenty leaves 0.95, wherever it stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import connected_components
from weftline.plans.lineage import counted, cut
from weftline.plans.spread import join_spread

#: Texts of fewer words are similar to equal texts only.
WORDS = 5
SIMILARITY = 0.8
#: Words of a sampled shingle. Where every fifth word is changed, 0.47 of all pairs of words are in common, so a sample
#: agrees with odds of 0.1 and none of them does with odds of 5 in 100; of runs of five words 0.2 are, which 28 samples
#: of three miss with odds of 8 in 10. A sample of three pairs tells texts apart by six words and their order.
SHINGLE = 2
PER_SAMPLE = 3
SAMPLES = 28
#: Samples of the first round. What it links needn't be compared again in the second, which takes the others.
FIRST_ROUND = 4
ROWS = 512
#: Nodes of a bucket, and bytes of their texts, that are compared in one block.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Bits of one mask of places in an alignment; longer texts have several.
MASK_BITS = 4096
#: Words beyond which an alignment is tried in narrow bands first.
LONG = 2048
#: Marks that are ranked at once for several samples.
RANKED = 1 << 18
#: Words whose hashes a task remembers.
WORDS_HELD = 1 << 20
#: Odd multipliers of the words of a shingle, and of the mixing step; those of the samples rank the mixed hashes.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)
_LAST = np.uint64(2**64 - 1)
_SEEDS = np.random.default_rng(20240131).integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, made once each."""

    def __missing__(self, word: bytes) -> int:
        self[word] = xxhash.xxh3_64_intdigest(word)
        return self[word]

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, which are runs of characters other than ASCII white space."""
        return np.fromiter(map(self.__getitem__, text.encode().split()), np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` words; a shorter text with any word is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(len(words) - SHINGLE + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total += words[k : k + n] * _PLACES[k]
    # Both ways: few words are summed, and the samples multiply once more.
    total ^= total >> _SHIFT
    total *= _MIX
    return total ^ total >> _SHIFT


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how often it has occurred before)."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if len(starts) == len(hashes):
        return hashes
    occurrence = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    out = np.empty_like(hashes)
    out[order] = ordered + occurrence.astype(np.uint64) * _PLACES[0]
    return out


def sketch(words: np.ndarray) -> list[int]:
    """One signed 64-bit number per sample; none for a text without words."""
    marks = labelled(shingles(words)) if len(words) else np.empty(0, np.uint64)
    if not len(marks):
        return []
    take = min(PER_SAMPLE, len(marks))
    some = max(1, RANKED // len(marks))
    out: list[int] = []
    for seeds in (_SEEDS[at : at + some] for at in range(0, SAMPLES, some)):
        rank, rows = marks * seeds[:, None], np.arange(len(seeds))
        first = np.empty((len(seeds), take), np.int64)
        for k in range(take):
            first[:, k] = rank.argmin(axis=1)
            rank[rows, first[:, k]] = _LAST
        first.sort(axis=1)
        out += [xxhash.xxh3_64_intdigest(drawn.tobytes(), int(seed)) - 2**63 for drawn, seed in zip(marks[first], seeds, strict=True)]
    return out


def _masks(words: list[int], shift: int) -> list[dict[int, int]]:
    """Per run of ``MASK_BITS`` places, the places of every word as bits; places are counted from ``shift``."""
    masks: list[dict[int, int]] = [{} for _ in range((len(words) + shift) // MASK_BITS + 1)]
    for at, word in enumerate(words, shift):
        mask, bit = masks[at // MASK_BITS], 1 << at % MASK_BITS
        mask[word] = mask.get(word, 0) | bit
    return masks


def matched_words(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> int:
    """Words that the best alignment of ``a`` and ``b`` matches in order; 0 if they are too few for a similarity of ``least``.

    Of the alignment's table only the band of places is filled that so many matches allow: at most n - needed words of
    ``a`` and m - needed of ``b`` stay single. A row of the band is one number with a bit per place, which is 0 where
    the count of matches grows; so memory is linear in the band, and rows follow from one another by a few operations.
    """
    n, m = len(a), len(b)
    needed = math.ceil(least * (n + m) / 2 - 1e-9)
    if min(n, m) < max(needed, 1):
        return 0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    start = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + start :][::-1] != b[m - short + start :][::-1])
    end = int(differ[0]) if len(differ) else short - start
    found, behind, width = start + end, m - needed, n + m - 2 * needed + 1
    left, right = a[start : n - end].tolist(), b[start : m - end].tolist()
    if not left or not right:
        return found if found >= needed else 0
    masks = _masks(left, behind)
    full, top = (1 << width) - 1, 1 << (width - 1)
    row = full
    for j, word in enumerate(right):
        here = 0
        for k in range(j // MASK_BITS, min((j + width - 1) // MASK_BITS + 1, len(masks))):
            if bits := masks[k].get(word):
                at = k * MASK_BITS - j
                here |= bits << at if at >= 0 else bits >> -at
        if here:
            step = row & here & full
            row = (row + step | row - step) & full
        # The band moves on by one place; what it leaves behind is settled.
        found += not row & 1
        row = row >> 1 | top
        if not j & 63 and found + width - row.bit_count() + len(right) - j - 1 < needed:
            return 0
    found += width - row.bit_count()
    return found if found >= needed else 0


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Twice the matched words over all words of both; 0 where it is under ``least``.

    ``a`` and ``b`` are word hashes. Texts of under five words are similar to equal texts only.
    """
    if len(a) < WORDS or len(b) < WORDS:
        return float(len(a) > 0 and np.array_equal(a, b))
    # Long texts try narrow bands first: an alignment found there is the best one.
    for share in (16, 4, 1) if len(a) > LONG else (1,):
        if found := matched_words(a, b, 1 - (1 - least) / share):
            return 2 * found / (len(a) + len(b))
    return 0.0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        if len(hashes) > WORDS_HELD:
            hashes.clear()
        sketches = [None if t is None else sketch(hashes.of(t)) for t in batch.column("text").to_pylist()]
        columns = [*(batch.column(c) for c in ("doc_id", "node", "bytes")), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "bytes", "sketch"])


class Joined:
    """Disjoint sets of the rows of one comparison."""

    def __init__(self, n: int):
        self.root, self.sets = list(range(n)), n

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.sets -= a != b
        self.root[b] = a


def spanning_links(words: list[np.ndarray], left: int, least: float, known: list) -> Joined:
    """Sets of the rows that links of similarity ``least`` connect; rows before ``left`` meet the others, or with 0 all meet.

    Rows with one name in ``known`` are connected already. For one row after another, its words' postings count what it
    has in common with all the others at once, which bounds every alignment from above. Pairs that could reach
    ``least`` are aligned, unless links found before connect them.
    """
    sets = Joined(len(words))
    first: dict[bytes, int] = {}
    for k, name in enumerate(known):
        sets.join(first.setdefault(name, k), k)
    marks = [labelled(w) if len(w) else w for w in words]
    sizes = np.array([len(m) for m in marks])
    ids = np.unique(np.concatenate(marks), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.argsort(ids, kind="stable")
    postings, start = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for x in range(left or len(words)):
        if sets.sets == 1:
            break
        own = ids[at[x] : at[x + 1]]
        lengths = start[own + 1] - start[own]
        places = np.repeat(start[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(postings[places], minlength=len(words))
        near = np.flatnonzero(2 * common >= least * (sizes[x] + sizes) - 1e-9)
        for y in near[near >= (left or x + 1)].tolist():
            if sizes[x] and sets.find(x) != sets.find(y) and similarity(words[x], words[y], least) > 0:
                sets.join(x, y)
    return sets


GROUP = ["key", "low", "high"]


def _compared(least: float):
    """Rows sorted by group -> (key, node, root): the nodes that a link in their group connects to one of another class."""

    def one(rows: list[dict]) -> Iterator[tuple]:
        hashes = WordHashes()
        left = sum(r["side"] == 0 for r in rows) if rows[-1]["side"] else 0
        sets = spanning_links([hashes.of(r["text"]) for r in rows], left, least, [r["class"] for r in rows])
        for k, r in enumerate(rows):
            root = rows[sets.find(k)]
            if r["class"] != root["class"]:
                yield r["key"], r["node"], root["node"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (found := list(one(held))):
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "root"])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for row in batch.to_pylist():
                group = tuple(row[c] for c in GROUP)
                if group != last:
                    yield from done()
                    held, last = [], group
                held.append(row)
        yield from done()

    return compare


def candidates(nodes: DataFrame) -> DataFrame:
    """(key, first, number) of all nodes that agree with another in a sample; ``first`` marks samples of the first round.

    ``number`` is a hash of the node, which keeps the rows of all samples narrow; nodes that share one stay apart later.
    """
    drawn = nodes.select(F.xxhash64("node").alias("number"), F.posexplode("sketch").alias("sample", "key"))
    drawn = drawn.select("key", (F.col("sample") < FIRST_ROUND).alias("first"), "number")
    repeated = drawn.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return drawn.join(repeated, "key")


def buckets(members: DataFrame, tasks: int) -> DataFrame:
    """``members`` (key, node, class, bytes) with blocks, own, hub and hub_class, for the buckets that may link classes.

    Of buckets with the same nodes one is enough; most nodes agree with the same others in several samples. ``blocks``
    says how many blocks hold the bucket's texts, ``own`` is the node's block and ``hub`` the bucket's smallest node.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in range(2)]
    span = [F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct("node", "class")).alias("hub")]
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"), *span, *marks).filter("low <> high").coalesce(tasks)
    chosen = sizes.groupBy("size", "mark0", "mark1").agg(F.min(F.struct("key", "bytes", "hub")).alias("b")).coalesce(tasks)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("b.bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    chosen = chosen.select("b.key", F.col("b.hub.node").alias("hub"), F.col("b.hub.class").alias("hub_class"), blocks.alias("blocks"))
    found = join_spread(members, chosen, ["key"], "node", "inner", tasks)
    return found.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _grouped(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Compare inside (key, low, high): rows have node, class and side; texts are joined here."""
    rows = rows.join(texts.select("node", "text"), "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "node")
    found, tasks = counted(rows.mapInArrow(_compared(least), "key long, node binary, root binary"))
    return found.coalesce(tasks)


def _rows(rows: DataFrame, low: Column, high: Column, side: Column) -> DataFrame:
    return rows.select("key", low.alias("low"), high.alias("high"), side.alias("side"), "node", "class")


def links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (node, root) that connect all nodes whose texts (node, text) are linked.

    What is narrow is joined and grouped by the tasks that its rows are worth; texts are compared by all.

    All nodes of a bucket meet. Beyond one block, its smallest node, the hub, meets every block first; what it links is
    one class, whose inner links change nothing. The others then meet the class and each other as pairs of blocks. So
    a bucket of copies takes one pass over its blocks, and none is gathered in one task or cut short.
    """
    members, tasks = counted(members)
    rows, tasks = counted(buckets(members.coalesce(tasks), tasks))
    rows = rows.coalesce(tasks)
    zero, one, own = F.lit(0), F.lit(1), F.col("own")
    large = rows.filter("blocks > 1")
    hubs = large.filter("node = hub").withColumn("at", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    first = [_rows(rows.filter("blocks = 1"), zero, zero, zero), _rows(large.filter("node <> hub"), own, zero, one), _rows(hubs, F.col("at"), zero, zero)]
    found = _grouped(first[0].unionByName(first[1]).unionByName(first[2]), texts, least)
    if large.isEmpty():
        return found.select("node", "root")

    tied = found.select("key", "node", F.lit(True).alias("tied")).distinct().coalesce(tasks)
    large = large.join(tied, ["key", "node"], "left").coalesce(tasks).withColumn("tied", F.coalesce("tied", F.col("class") == F.col("hub_class")))
    large, tasks = counted(large.withColumn("class", F.when(F.col("tied"), F.col("hub_class")).otherwise(F.col("class"))))
    large = large.coalesce(tasks)
    others = large.filter("not tied")
    count = others.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.max("blocks").alias("most")).coalesce(tasks)
    # No more blocks than the whole bucket has, so none holds more than there.
    count = count.select("key", F.least("most", "n").alias("parts"))
    others = join_spread(others, count, ["key"], "node", "inner", tasks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    held = join_spread(large.filter("tied"), count, ["key"], "node", "inner", tasks).withColumn("place", F.col("parts") + F.col("own"))
    each = F.explode(F.sequence(zero, F.col("parts") - 1))
    met = _rows(held.withColumn("at", each), F.col("at"), F.col("place"), one)
    facing = others.join(held.select("key", "place").distinct().coalesce(tasks), "key")
    pairs = others.withColumn("other", each)
    among = _rows(pairs, F.least("own", "other"), F.greatest("own", "other"), (F.col("own") > F.col("other")).cast("int"))
    rest = _grouped(met.unionByName(_rows(facing, own, F.col("place"), zero)).unionByName(among), texts, least)
    return found.unionByName(rest).select("node", "root")


def text_classes(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, component) of the nodes (node, bytes, sketch) that aren't the smallest of their class.

    First, all nodes meet in the buckets of a few samples. Then one node of each class meets in all buckets: this joins
    most that belongs together without sending out whole classes. Last, all nodes meet in the buckets of the other
    samples that still hold different classes. A bucket of one class has nothing to add.
    """
    found, tasks = counted(candidates(nodes))
    found = found.coalesce(tasks)
    named = found.select("number").distinct()
    texts = texts.withColumn("number", F.xxhash64("node")).join(named, "number", "left_semi")
    texts = cut(texts.groupBy("node").agg(F.first("number").alias("number"), F.first("bytes").alias("bytes"), F.first("text").alias("text")))
    sizes = texts.select("number", "node", "bytes")
    members = cut(found.join(sizes, "number").coalesce(tasks).select("key", "first", "node", "bytes"))
    classes = connected_components(links(members.filter("first").withColumn("class", F.col("node")), texts, least), "node", "root")
    for one_each in (True, False):
        met = (members if one_each else members.filter("not first")).join(classes, "node", "left").coalesce(tasks).withColumn("class", F.coalesce("component", "node"))
        if one_each:
            met = met.groupBy("key", "class").agg(F.min(F.struct("node", "bytes")).alias("least")).coalesce(tasks).select("key", "class", "least.*")
        more = links(met.select("key", "node", "class", "bytes"), texts, least)
        # What is known hangs on the smallest node of its class already.
        classes = connected_components(classes.withColumnRenamed("component", "root").unionByName(more), "node", "root")
    return classes


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, class_id, n_texts and kept.

    Equal texts are one node. Nodes that agree in a sample are candidates; those whose aligned words are at least
    ``least`` similar are linked, and class_id is the smallest doc_id of all documents reachable by links. All nodes
    of a bucket are compared, but for pairs that links found before connect already: these can't change a class, so
    none is lost. ``n_texts`` counts the different texts of the class, ``kept`` marks its class_id.

    A null text, and a null id, are in no class but their own (class_id is the doc_id); texts of under five words link
    with equal texts only. Very long texts are compared whole, in memory linear in their length. Rows that repeat an id
    and a text get equal results; different texts under one id are different documents. An empty table gives no rows;
    extra columns are ignored. Sketches and ids are narrow; texts move once to meet the list of candidates, unless that
    is small enough for Spark to send it to them, and candidates' texts once per block in which they are compared.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("node"), F.octet_length(F.col(text)).cast("long").alias("bytes"))
    rows, tasks = counted(named.mapInArrow(_sketched, "doc_id long, node binary, bytes long, sketch array<long>"))
    usable = rows.filter("node is not null and doc_id is not null")
    nodes = usable.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bytes").alias("bytes"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes)
    classes = text_classes(nodes, named.filter("node is not null").select("node", "bytes", "text"), least)
    ids = nodes.select("node", "first").join(classes, "node", "left").select("node", "first", F.coalesce("component", "node").alias("class"))
    ids = cut(ids.coalesce(tasks))
    by_class = ids.groupBy("class").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts")).coalesce(tasks)
    placed = join_spread(ids, by_class, ["class"], "node", "inner", tasks).select("node", "class_id", "n_texts")
    own = F.col("node").isNull() | F.col("doc_id").isNull()
    out = join_spread(rows.select("doc_id", "node").coalesce(tasks), placed, ["node"], "doc_id", "left", tasks).select(
        "doc_id", F.lower(F.hex("node")).alias("text_md5"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("n_texts")).cast("long").alias("n_texts"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
