"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.quality import BLANK, count_runs
from weftline.plans.lineage import cut
from weftline.plans.spread import join_spread

#: Slices of the sampling order; only the slice that holds a source's cut is ordered row by row.
SLICES = 4096
#: Equal rows of which only some are taken are made anew in runs of so many.
RUN = 1000
#: Odds are kept finite.
EDGE = 1e-9
#: Up to so many sources, their table of a few numbers each is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return count_runs(F.coalesce(F.col(text), F.lit("")), BLANK)


def _drawn(docs: DataFrame, size: Column, favour: Callable[[Column], Column], seed: int, doc_id: str, source: str) -> DataFrame:
    """Add the source's key, the size, the favour and a uniform number made of the seed, the id and the size."""
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    df = docs.withColumns({"_m_source": named, "_m_size": size})
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("_m_size").cast("string")))
    # Rows with one key are told apart by their other columns; those that still agree are equal.
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    df = df.withColumns({"_m_key": key, "_m_tie": F.xxhash64(*map(F.col, plain)), "_m_favour": favour(F.col("_m_size")).cast("double")})
    digits = F.conv(F.substring("_m_key", 1, 13), 16, 10).cast("double")
    return df.withColumn("_m_uniform", (digits + 0.5) / float(2**52))


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target words of every source, from one row per source (_m_source, source, _m_total, ...).

    ``share`` times all words is dealt to the sources by weight; no source gets over ``most`` times its words, and
    the excess goes to the others by weight. With the sources in order of the level at which each is full, the
    common level is that of the first source which it doesn't fill.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(named) - 1) % len(weights) + 1)
    df = totals.withColumn("_weight", weight).withColumn("_full", most * F.col("_m_total"))
    by_level = Window.orderBy(F.col("_full") / F.col("_weight"), "_m_source")
    before = F.coalesce(F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    dealt = share * F.sum("_m_total").over(Window.partitionBy())
    df = df.withColumn("_level", (dealt - before) / after)
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_full"), F.struct(F.col("_full") / F.col("_weight"), F.col("_level").alias("at"))))
    df = df.withColumn("_common", level.over(Window.partitionBy())["at"])
    target = F.least(F.col("_full"), F.coalesce(F.col("_common") * F.col("_weight"), F.col("_full")))
    return df.withColumn("target", target).drop("_weight", "_full", "_level", "_common")


def _chances(df: DataFrame, most: float) -> DataFrame:
    """Add whole copies and the place in the sampling order to drawn rows that know their source's figures."""
    ratio = F.when(F.col("_m_total") > 0, F.col("target") / F.col("_m_total")).otherwise(0.0)
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("_m_scale") * F.col("_m_favour"), F.lit(float(most))))
    whole = F.floor(expected)
    df = df.withColumns({"_m_whole": F.least(whole, F.lit(int(most))), "_m_chance": expected - whole})

    def odds(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
        return p / (1 - p)

    # Random odds over inclusion odds, scaled by the odds of the source as a whole so that slices fill evenly.
    rank = odds(F.col("_m_uniform")) / odds(F.col("_m_chance")) * odds(ratio - F.floor(ratio))
    return df.withColumn("_m_order", rank / (1 + rank))


def _scales(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Per source the factor of the favour with which expected copies, at most ``most``, add up to the target.

    By falling favour, documents are full at ``most`` up to some favour; the factor is that of the first one that it
    leaves below. No row for a source all of whose documents are full.
    """
    kinds = rows.groupBy("_m_source", "_m_favour").agg(F.sum("_m_size").alias("_words"))
    kinds = kinds.join(targets.select("_m_source", "target"), "_m_source")
    order = Window.partitionBy("_m_source").orderBy(F.col("_m_favour").desc())
    full = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("_m_favour") * F.col("_words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    kinds = kinds.withColumn("_scale", F.try_divide(F.col("target") - full, rest))
    fits = F.col("_scale") * F.col("_m_favour") <= most * (1 + 1e-12)
    return kinds.filter(fits).groupBy("_m_source").agg(F.max_by("_scale", "_m_favour").alias("_m_scale"))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan), "_m_source") if small else join_spread(rows, plan, ["_m_source"], "_m_key", "inner")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...],
    share: float = 1.0,
    most: int = 2,
    seed: int = 0,
    size: Column | None = None,
    favour: Callable[[Column], Column] = lambda size: F.lit(1.0),
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and copies, the number of times the mix takes the row (0 to ``most``).

    ``share`` times the words of all documents is dealt to the sources, in the order of their names with null last,
    by the repeating ``weights``, none getting over ``most`` times its own words. How often a document is expected
    is in proportion to ``favour`` of its size, at most ``most``, and so that its source's target is met. The whole part
    is certain.
    The rest of the target is filled in Pareto order, random odds over inclusion odds, up to the document whose
    middle crosses it; so the words taken miss the target by half a document at most.

    Random numbers come from the seed, the id and the size, so reruns agree. Rows that share both are ordered by their
    other columns; of rows that are equal in all columns, any may be taken, and as many are as the target has room for.
    Null texts have size 0, null sources are a source of their own, null ids are ids like others; an empty table
    gives no rows. Columns of ``docs`` named like the added ones are replaced; names in ``_m_`` are reserved. Running
    sums go over slices of the order, so no source is gathered in one task, and texts are never shuffled.
    """
    size = word_count() if size is None else size
    drawn = _drawn(docs, size, favour, seed, doc_id, source)
    rows = cut(drawn.select(F.col(source).alias("source"), "_m_source", "_m_size", "_m_favour", "_m_key", "_m_tie", "_m_uniform"))
    totals = rows.groupBy("_m_source", "source").agg(F.sum("_m_size").alias("_m_total"))
    targets = cut(source_targets(totals, weights, share, float(most)).drop("source"))
    targets = cut(targets.join(_scales(rows, targets, float(most)), "_m_source", "left"))
    ends = _ends(_chances(_joined(rows.drop("source"), targets), most), most)
    plan = cut(targets.join(ends, "_m_source", "left"))
    placed = _chances(_joined(drawn, plan), most)
    place = F.struct("_m_order", "_m_key", "_m_tie")
    sampled = (F.col("_m_whole") < most) & (F.col("_m_end").isNull() | (place < F.col("_m_end")))
    if not plan.filter("_m_part > 0").isEmpty():
        parted = F.coalesce((F.col("_m_whole") < most) & (F.col("_m_part") > 0) & (place == F.col("_m_end")), F.lit(False))
        placed = _parted(placed.withColumn("_m_parted", parted), docs.columns)
        sampled = F.coalesce(F.col("_m_number") < F.col("_m_part"), sampled)
    added = {"size": F.col("_m_size"), "source_size": F.col("_m_total"), "target": F.col("target")}
    added["copies"] = (F.col("_m_whole") + sampled.cast("int")).cast("int")
    kept = [c for c in docs.columns if c not in added]
    return placed.select(*kept, *(c.alias(name) for name, c in added.items()))


def _parted(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Number the equal rows at a source's cut, which only some of are taken, in ``_m_number``; it is null for the others.

    They are counted and made anew from one of them, in runs, so they are gathered in no task.
    """
    keys = ["_m_source", "_m_order", "_m_key", "_m_tie"]
    others = placed.filter(~F.col("_m_parted")).withColumn("_m_number", F.lit(None).cast("long"))
    kept = [c for c in placed.columns if c not in keys]
    equal = placed.filter("_m_parted").groupBy(*keys).agg(*(F.first(c).alias(c) for c in kept), F.count("*").alias("_m_rows"))
    runs = equal.withColumn("_m_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m_rows") - 1) / RUN))))
    runs = runs.repartition(*keys, "_m_run")
    last = F.least(F.col("_m_rows"), (F.col("_m_run") + 1) * RUN) - 1
    made = runs.withColumn("_m_number", F.explode(F.sequence(F.col("_m_run") * RUN, last)))
    return others.unionByName(made.select(*others.columns))


def _ends(placed: DataFrame, most: int) -> DataFrame:
    """Where the sampling order of a source is cut: the place (order, key, tie) of its first row left out; no row if all are in.

    Equal rows have one place; ``_m_part`` says how many of those at the cut are in.
    """
    placed = placed.withColumn("_slice", F.least(F.floor(F.col("_m_order") * SLICES), F.lit(SLICES - 1)))
    open_size = F.when(F.col("_m_whole") < most, F.col("_m_size")).otherwise(0)
    slices = placed.groupBy("_m_source", "_slice").agg(
        F.sum(F.col("_m_whole") * F.col("_m_size")).alias("_certain"), F.sum(open_size).alias("_open"), F.min("target").alias("_aim")
    )
    source = Window.partitionBy("_m_source")
    upto = F.sum("_open").over(source.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.withColumns({"_budget": F.col("_aim") - F.sum("_certain").over(source), "_upto": upto})
    slices = slices.withColumn("_base", F.col("_upto") - F.col("_open"))
    crossing = cut(slices.filter((F.col("_upto") > F.col("_budget")) & (F.col("_base") <= F.col("_budget"))))
    crossing = crossing.select("_m_source", "_slice", "_budget", "_base")
    inside = placed.filter(F.col("_m_whole") < most).join(crossing, ["_m_source", "_slice"])
    inside = inside.groupBy("_m_source", "_budget", "_base", "_m_order", "_m_key", "_m_tie", "_m_size").agg(F.count("*").alias("_n"))
    words = F.col("_n") * F.col("_m_size")
    run = source.orderBy("_m_order", "_m_key", "_m_tie").rowsBetween(Window.unboundedPreceding, 0)
    # The middle of the first of the equal rows; that of each next one lies their size further on.
    inside = inside.withColumn("_middle", F.col("_base") + F.sum(words).over(run) - words + F.col("_m_size") / 2)
    fits = F.floor(F.try_divide(F.col("_budget") - F.col("_middle"), F.col("_m_size"))) + 1
    part = F.when(F.col("_middle") > F.col("_budget"), 0).when(F.col("_m_size") == 0, F.col("_n")).otherwise(F.least("_n", fits))
    left_out = inside.withColumn("_part", part.cast("long")).filter(F.col("_part") < F.col("_n"))
    first = left_out.groupBy("_m_source").agg(F.min(F.struct(F.struct("_m_order", "_m_key", "_m_tie").alias("end"), "_part")).alias("_first"))
    next_slice = F.struct(((F.col("_slice") + 1) / float(SLICES)).alias("_m_order"), F.lit("").alias("_m_key"), F.lit(0).cast("long").alias("_m_tie"))
    ends = crossing.join(first, "_m_source", "left")
    return ends.select("_m_source", F.coalesce("_first.end", next_slice).alias("_m_end"), F.coalesce("_first._part", F.lit(0)).alias("_m_part"))
