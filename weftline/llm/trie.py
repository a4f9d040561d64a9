"""Prefix trie of conversations by smallest-member ownership.

A node is a sequence of first turns. It belongs to the smallest conversation that begins with it; that conversation then
owns every deeper node of its path as well, so each conversation owns a suffix of its path and no tree is ever built.
What a subtree holds is a sum over its members: all tokens below a node, less those of the nodes that members own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scans import in_blocks, running
from weftline.plans.lineage import cut
from weftline.plans.spread import SALTS, join_spread

#: Conversation ids that one row of the end lists holds.
PACK = 4096
NODE = ["depth", "k0", "k1"]


def narrow_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 1), mark and tokens of every turn: its place, a digest of role and text, and the text's code points.

    Turns stand by ``turn``, null first; equal turns by their marks. A null role or text is empty; rows without a
    conversation are left out. Texts go no further than here.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"), F.length(text).cast("long").alias("tokens"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("mark")]
    return running(in_blocks(rows, "conv_id", *order), ["conv_id"], order, {"position": F.lit(1)}).drop("turn")


def rebuilt_turns(turns: DataFrame, share: int = 100, kinds: int = 6) -> DataFrame:
    """Turns of :func:`narrow_turns` as conversations that share beginnings: conv_id, depth, n_turns, mark, tokens and _block.

    The first h turns of conversation c become those of conversation c - c % ``share`` (fewer if it has fewer, none if
    it is absent); h is the checksum of c modulo ``kinds``. Depth 0 is a row of its own, so a conversation without any
    turn is there too. At most ``share`` conversations read the few first turns of another one.
    """
    turns = cut(turns)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(kinds)).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select("conv_id", "size", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    held = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = cut(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    first = turns.filter(F.col("position") < kinds).select(F.col("conv_id").alias("base"), "position", "mark", "tokens")
    heads = convs.join(first, "base").filter(F.col("position") <= F.col("taken"))
    before = F.lit(-1).alias("_block")
    heads = heads.select("conv_id", F.col("position").alias("depth"), "n_turns", "mark", "tokens", before)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_turns", F.lit(None).cast("string").alias("mark"), F.lit(0).cast("long").alias("tokens"), before)
    own = join_spread(turns, convs.select("conv_id", "h", "taken", "n_turns"), ["conv_id"], "position", "inner").filter("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "n_turns", "mark", "tokens", "_block")
    return roots.unionByName(heads).unionByName(own)


def whole_turns(turns: DataFrame) -> DataFrame:
    """Turns of :func:`narrow_turns` as they are, in the form of :func:`rebuilt_turns`."""
    turns = cut(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    roots = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_turns", F.lit(None).cast("string").alias("mark"), F.lit(0).cast("long").alias("tokens"), F.lit(-1).alias("_block"))
    own = join_spread(turns, sizes, ["conv_id"], "position", "inner")
    return roots.unionByName(own.select("conv_id", F.col("position").alias("depth"), "n_turns", "mark", "tokens", "_block"))


def _half(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation -> one row per node and ``PACK`` ids, which it joins by commas."""
    node: tuple | None = None
    ids: list[str] = []
    first = 0

    def done() -> Iterator[pa.RecordBatch]:
        if ids:
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(NODE, node, strict=True)}, "first": [first], "ids": [",".join(ids)]})

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv_id"]), strict=True):
            if tuple(key) != node or len(ids) == PACK:
                yield from done()
                node, ids, first = tuple(key), [], conv
            ids.append(str(conv))
    yield from done()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by node and first id -> the digest of all ids of a node, which are read as they come."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
            if tuple(key) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = tuple(key), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip([*NODE, "ends_sha256"], map(list, zip(*out, strict=True)), strict=True)))
    if node is not None:
        yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(NODE, node, strict=True)}, "ends_sha256": [digest.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k0, k1 and ends_sha256: the digest of the ids (depth, k0, k1, conv_id) of a node in numeric order.

    Ids of a node that hold a large part of all conversations are packed where their range lies, so a digest, which
    only one task can make, reads few rows and holds one of them at a time.
    """
    shape = "depth long, k0 long, k1 long"
    packed = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = packed.mapInArrow(_packed, f"{shape}, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, f"{shape}, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths``, as :func:`rebuilt_turns` or :func:`whole_turns` give them.

    conv_id, depth, parent_conv_id: the node's owner, its depth, the owner of its parent; n_convs, n_children, n_leaves:
    conversations that begin with it, its children, the childless nodes of its subtree; saved_tokens: what the subtree
    need not store twice; ends_sha256: digest of the conversations that end here.

    A node's key is the exclusive or of 128-bit digests of all its turns with their places. Owners come from minima of
    slices of a node's occurrences, so the root or a beginning that all share is gathered nowhere; the rest is one
    running sum along every path and one group-by of the keys. An empty table has no node; rows that repeat are turns.
    """
    placed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("mark")))
    rows = paths.withColumns({"m0": F.coalesce(_half(placed, 0), F.lit(0).cast("long")), "m1": F.coalesce(_half(placed, 1), F.lit(0).cast("long"))}).drop("mark")
    rows = running(rows, ["conv_id"], [F.asc("depth")], {"k0": F.col("m0"), "k1": F.col("m1")}, how="xor")
    rows = cut(rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")))

    slices = rows.groupBy(*NODE, "_salt").agg(F.min("conv_id").alias("owner"), F.max(F.col("n_turns") > F.col("depth")).alias("deeper"))
    node = Window.partitionBy(*NODE)
    slices = slices.withColumns({"owner": F.min("owner").over(node), "deeper": F.max("deeper").over(node)})
    marked = rows.join(slices, [*NODE, "_salt"])
    owned = (F.col("conv_id") == F.col("owner")).cast("long")
    marked = marked.withColumns({"owned": owned, "leaf": owned * (~F.col("deeper")).cast("long")}).drop("owner", "deeper", "_salt")
    sums = {"below": F.col("tokens") * (1 - F.col("owned")), "leaves": F.col("leaf"), "held": F.col("owned")}
    marked = running(marked, ["conv_id"], [F.desc("depth")], sums, backward=True)
    # Ownership is a suffix of the path: the next node is owned if all that follow are.
    follow = F.col("n_turns") - F.col("depth")
    child = (follow > 0) & (F.col("held") - F.col("owned") == follow)
    nodes = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("below").alias("saved_tokens"),
        F.min(F.col("k0").bitwiseXOR(F.col("m0"))).alias("p0"), F.min(F.col("k1").bitwiseXOR(F.col("m1"))).alias("p1"),
    )
    nodes = cut(nodes)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    found = join_spread(nodes, parents, ["depth", "p0", "p1"], "k0").join(end_digests(rows.filter("depth = n_turns")), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.select(*names, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
