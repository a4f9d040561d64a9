"""Scores and gates of the clustering decision, as columns over pairs of an article and a candidate story.

Articles have a_* columns, stories s_*: title, published_at / last_at, entities, domain, geo fields, slug / slugs,
artifacts, quotes, opinion; sim is the embedding similarity on the scale that the gates are set for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import config
from weftline.functions import text as T


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def time_score(a: Column, b: Column, hours: float = 72.0) -> Column:
    """1 at the same time, 0 from ``hours`` on; 0.5 if one is missing."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(hours_between(a, b)) / hours))


def told_entities(ids: Column) -> Column:
    return F.array_distinct(F.filter(ids, lambda e: e.isNotNull() & ~e.isin(*config.STOP_ENTITIES)))


def entity_score(a: Column, s: Column) -> tuple[Column, Column]:
    """Jaccard of entities that tell stories apart, and how many are shared."""
    left, right = told_entities(a), told_entities(s)
    shared = F.coalesce(F.size(F.array_intersect(left, right)), F.lit(0))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(s) > 0), T.jaccard(left, right)), F.lit(0.0)), F.greatest(shared, F.lit(0))


def geo_score(pairs: list[tuple[str, str]]) -> Column:
    """Share of the fields known on both sides that are equal."""
    known = reduce(Column.__add__, [F.when((F.col(a) != "") & (F.col(s) != ""), 1).otherwise(0) for a, s in pairs])
    equal = reduce(Column.__add__, [F.when((F.col(a) != "") & (F.col(a) == F.col(s)), 1).otherwise(0) for a, s in pairs])
    return F.when(known > 0, equal / known).otherwise(0.0)


def shares_any(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def hybrid_scores(pairs: DataFrame, thresholds: config.Thresholds | None = None) -> DataFrame:
    """Components and total of the hybrid score. Equal outlets count, also where both are missing."""
    t = thresholds or config.Thresholds()
    w, b = config.WEIGHTS, config.BONUSES
    entities, shared = entity_score(F.col("a_entities"), F.col("s_entities"))
    terms = {"_a_terms": T.term_counts(F.col("a_title")), "_s_terms": T.term_counts(F.col("s_title"))}
    df = pairs.withColumns(terms).withColumns(
        {
            "embedding_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sim"))),
            "entity_score": entities,
            "shared_entities": shared,
            "title_score": T.title_similarity(F.col("_a_terms"), F.col("_s_terms")),
            "time_score": time_score(F.col("a_published_at"), F.col("s_last_at"), t.decay_hours),
            "geo_score": geo_score([(f"a_{g}", f"s_{g}") for g in ("country", "state", "city") if f"a_{g}" in pairs.columns]) if "a_country" in pairs.columns else F.lit(0.0),
        }
    )
    bonus = F.when(F.col("a_domain").eqNullSafe(F.col("s_domain")), b["outlet"]).otherwise(0.0)
    for name in ("artifacts", "quotes"):
        if f"a_{name}" in pairs.columns:
            bonus += F.when(shares_any(F.col(f"a_{name}"), F.col(f"s_{name}")), b[name]).otherwise(0.0)
    base = (
        w["embedding"] * F.col("embedding_score") + w["entities"] * F.col("entity_score") + w["title"] * F.col("title_score")
        + w["time"] * F.col("time_score") + w["geography"] * F.col("geo_score")
    )
    return df.drop("_a_terms", "_s_terms").withColumn("total", F.least(base + bonus, F.lit(1.0)))


def threshold(domain: Column, opinion: Column, has_artifacts: Column, t: config.Thresholds | None = None) -> Column:
    t = t or config.Thresholds()
    wire = reduce(Column.__or__, [F.coalesce(domain, F.lit("")).contains(d) for d in config.WIRE_DOMAINS])
    return F.when(wire, t.wire).when(opinion, t.opinion).when(has_artifacts, t.policy).otherwise(t.default)


def slug_match(article: Column, stories: Column, t: config.Thresholds | None = None) -> Column:
    """The best of the story's slugs by the share of tokens in common: struct of share, count, event, anchor and passes.

    The first slug with the greatest share counts, even if a later one with the same share would pass.
    """
    t = t or config.Thresholds()
    roots = F.array(*map(F.lit, sorted(set(config.EVENT_ROOTS.values()))))

    def compare(own: Column, other: Column) -> Column:
        def figures(common: Column) -> Column:
            count = F.size(common)
            share = F.when((F.size(own) >= 2) & (F.size(other) >= 2), count / F.least(F.size(own), F.size(other))).otherwise(0.0)
            event = F.exists(common, lambda x: x.isin(*config.HIGH_SIGNAL_EVENTS))
            anchor = F.size(F.array_except(common, roots)) > 0
            passes = (count >= t.overlap_count) & (share >= t.overlap_share) & event & anchor
            return F.struct(share.alias("share"), count.alias("count"), event.alias("event"), anchor.alias("anchor"), passes.alias("passes"))

        return T.let(F.array_intersect(own, other), figures)

    none = F.struct(F.lit(0.0).alias("share"), F.lit(0).alias("count"), F.lit(False).alias("event"), F.lit(False).alias("anchor"), F.lit(False).alias("passes"))

    def best(own: Column) -> Column:
        found = F.transform(stories, lambda slug: T.let(T.slug_tokens(slug), lambda other: compare(own, other)))
        return F.aggregate(found, none, lambda top, x: F.when(x["share"] > top["share"], x).otherwise(top))

    return T.let(T.slug_tokens(article), best)


def guardrail(sim: Column, exact_slug: Column, slug_tokens: Column, shared_entities: Column, title: Column, t: config.Thresholds | None = None) -> Column:
    """A similar embedding alone isn't enough: it must be very high or have a reason beside it."""
    t = t or config.Thresholds()
    reason = (sim >= t.very_high_embedding) | exact_slug | ((sim >= t.token_embedding) & slug_tokens) | (shared_entities > 0) | (title >= t.min_title)
    return (sim >= t.min_embedding) & reason


def ranked(pairs: DataFrame, key: str, candidate: str) -> DataFrame:
    """Candidates of an article by total score and by embedding, with the margin over the next one by embedding."""
    by_total = Window.partitionBy(key).orderBy(F.col("total").desc(), candidate)
    by_sim = Window.partitionBy(key).orderBy(F.col("sim").desc(), candidate)
    return pairs.withColumns(
        {
            "rank_total": F.row_number().over(by_total),
            "rank_sim": F.row_number().over(by_sim),
            "margin": F.col("sim") - F.lead("sim").over(by_sim),
            "candidates": F.count("*").over(Window.partitionBy(key)),
        }
    )


def decisions(best: DataFrame, t: config.Thresholds | None = None) -> DataFrame:
    """The gates of the best candidate by embedding and which of them decides.

    A missing margin, that of a single candidate, passes both tiers but tier A then asks for more similarity. Gates
    that fail are listed in their order; there a missing margin counts as a failure.
    """
    t = t or config.Thresholds()
    single = F.col("margin").isNull()
    margin = single | (F.col("margin") >= t.margin)
    close = F.coalesce(F.col("hours") <= t.tier_a_hours, F.lit(False))
    near = F.coalesce(F.col("hours") <= t.tier_b_hours, F.lit(False))
    reason = F.when(F.col("slug_passes"), "slug").when(F.col("shared_entities") > 0, "entity").when(F.col("title_overlap") > 0, "title").otherwise("none")
    tier_a = F.col("guardrail") & close & margin & (F.col("sim") >= F.when(single, t.tier_a_single).otherwise(t.tier_a))
    tier_b = F.col("guardrail") & near & margin & (F.col("sim") >= t.tier_b) & (reason != "none")
    primary = F.col("guardrail") & (F.col("total") >= F.col("threshold"))
    gates = {"guardrail": F.col("guardrail"), "time": near, "embed": F.col("sim") >= t.tier_b, "corroboration": reason != "none", "margin": F.coalesce(F.col("margin") >= t.margin, F.lit(False))}
    blocked = F.array_compact(F.array(*(F.when(~gate, F.lit(name)) for name, gate in gates.items())))
    decision = F.when(primary, "attach").when(tier_a, "tier_a").when(tier_b, "tier_b").otherwise("create")
    shadow = {f"shadow_{int(level * 100)}": F.col("guardrail") & near & (F.col("sim") >= level) & F.when(reason == "title", level >= 0.88).otherwise(reason != "none") for level in t.shadow}
    return best.withColumns({"decision": decision, "corroboration": reason, "blocked_by": F.array_join(blocked, ","), **shadow})


def legacy_title_points(jaro: Column) -> Column:
    """Points of a title by its Jaro-Winkler similarity, in four pieces."""
    return F.floor(
        F.when(jaro >= 1.0, 45.0).when(jaro > 0.85, 40 + (jaro - 0.85) * 33).when(jaro > 0.70, 28 + (jaro - 0.70) * 80).when(jaro > 0.50, 15 + (jaro - 0.50) * 65).otherwise(jaro * 30)
    ).cast("int")


def legacy_date_points(hours: Column) -> Column:
    return F.when(hours <= 24, 10).when(hours <= 48, 5).otherwise(0)


def lifecycle(last: Column, as_of: Column) -> Column:
    """emerging, growing, stable or stale by the hours since the last sign of life."""
    hours = hours_between(as_of, last)
    return F.when(hours < 6, "emerging").when(hours < 48, "growing").when(hours < 120, "stable").otherwise("stale")


def same_run_attach(sim: Column, total: Column, threshold: Column, guard: Column, same_run: Column, margin: Column, slug: Column, hours: Column, t: config.Thresholds | None = None) -> Column:
    """A story of the same run attaches below the total's threshold if its embedding is very close and one more sign agrees.

    A single candidate leads by all of its similarity.
    """
    t = t or config.Thresholds()
    sign = (F.coalesce(margin, sim) >= t.margin) | F.coalesce(slug, F.lit(False)) | F.coalesce(hours < 2, F.lit(False))
    return same_run & (sim >= t.very_high_embedding) & (total < threshold) & guard & sign


def time_anchor(*times: tuple[str, Column]) -> Column:
    """The first known time and its name."""
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("at"), F.lit(name).alias("source"))) for name, c in times))


def confident_entities(entities: Column, least: float = 0.70) -> Column:
    """(id, confidence) of entities with at least ``least``, the greatest per id; a missing confidence counts as sure."""
    sure = F.transform(entities, lambda e: F.struct(e["id"].alias("id"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence")))
    kept = F.filter(sure, lambda e: (e["confidence"] >= least) & e["id"].isNotNull())
    ids = F.array_sort(F.array_distinct(F.transform(kept, lambda e: e["id"])))
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.array_max(F.transform(F.filter(kept, lambda e: e["id"] == i), lambda e: e["confidence"])).alias("confidence")))
