"""Pairs of 64-bit fingerprints within a few bits, by block permutations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

BITS = 64
#: Fingerprints of a bucket that meet in one block.
BLOCK = 1024


def masks(within: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - within`` of the blocks into which the bits are cut, as signed numbers.

    Two fingerprints that differ in ``within`` bits differ in so many blocks at most, so under one of the masks they agree.
    """
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    whole = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if (m := sum(c)) >> (BITS - 1) else m for c in combinations(whole, blocks - within)]


def hamming_pairs(rows: DataFrame, fingerprint: str = "fingerprint", key: str = "id", within: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance, n_a, n_b): all pairs of different fingerprints at most ``within`` bits apart.

    A fingerprint stands for all rows that have it, under their smallest key, and n_a and n_b count them; so copies are
    not expanded into pairs. Fingerprints meet under every mask beneath which they are equal; a bucket of many is dealt
    out as pairs of blocks. Null fingerprints are near nothing.
    """
    if not 0 < within < blocks:
        raise ValueError("there must be more blocks than bits that may differ")
    each = rows.filter(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("f")).agg(F.min(key).alias("k"), F.count("*").alias("n"))
    each = cut(each)
    keyed = each.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(F.lit(m)) for m in masks(within, blocks)))).alias("mask", "part"))
    sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
    met = keyed.join(sizes, ["mask", "part"]).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = [met.select("mask", "part", F.col("f").alias(name), F.col(mine).alias("i"), F.col(theirs).alias("j")) for name, mine, theirs in (("x", "own", "other"), ("y", "other", "own"))]
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    pairs = sides[0].join(sides[1], ["mask", "part", "i", "j"]).filter((F.col("x") < F.col("y")) & (apart <= within)).select("x", "y", apart.alias("distance")).distinct()
    left, right = (each.select(F.col("f").alias(f), F.col("k").alias(f"k_{f}"), F.col("n").alias(f"n_{f}")) for f in ("x", "y"))
    found = pairs.join(left, "x").join(right, "y")
    swap = F.col("k_x") > F.col("k_y")
    pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    return found.select(pick("k_x", "k_y").alias("a"), pick("k_y", "k_x").alias("b"), "distance", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"))
