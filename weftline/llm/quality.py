"""Quality rules: base counts and the divergence of a text's histograms from its language's reference."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
SYMBOL = r"[#*$%&|<>]"

#: Classes of characters, in the order of every reference histogram.
CHAR_CLASSES = ("space", "upper", "digit", "punctuation", "symbol", "other")


def count_runs(text: Column, between: str) -> Column:
    """Number of runs of characters outside the class ``between``.

    Every run, with what is around it, shrinks to one character; this is cheaper than an array of the runs.
    """
    run = F.length(F.regexp_replace(text, rf"[{between}]*[^{between}]+[{between}]*", "x"))
    return F.when(text.rlike(f"[^{between}]"), run).otherwise(0).cast("long")


@dataclass(frozen=True)
class LanguageReference:
    """Shares of the classes of characters in running prose, and of its commonest words among all words.

    The words are lower case, without punctuation; the rest of the words make up one more class.
    """

    chars: tuple[float, ...]
    words: dict[str, float]


#: Rounded shares in general prose.
REFERENCES = {
    "en": LanguageReference((0.17, 0.02, 0.005, 0.03, 0.0005, 0.7745), {"the": 0.055, "of": 0.03, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.02, "is": 0.01, "that": 0.01, "for": 0.01, "it": 0.009, "was": 0.008, "with": 0.007}),
    "de": LanguageReference((0.15, 0.04, 0.005, 0.03, 0.0005, 0.7745), {"der": 0.033, "die": 0.033, "und": 0.028, "in": 0.018, "den": 0.012, "von": 0.01, "zu": 0.012, "das": 0.01, "mit": 0.009, "sich": 0.008, "des": 0.008, "ist": 0.008}),
    "fr": LanguageReference((0.16, 0.02, 0.005, 0.035, 0.0005, 0.7795), {"de": 0.05, "la": 0.028, "le": 0.026, "et": 0.023, "les": 0.019, "des": 0.018, "en": 0.014, "un": 0.012, "une": 0.011, "que": 0.011, "est": 0.011, "du": 0.011}),
    "es": LanguageReference((0.165, 0.02, 0.005, 0.03, 0.0005, 0.7795), {"de": 0.06, "la": 0.037, "que": 0.03, "el": 0.028, "en": 0.027, "y": 0.026, "a": 0.02, "los": 0.016, "se": 0.012, "del": 0.011, "las": 0.011, "un": 0.01}),
}


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the rules.

    ``max_*_divergence`` are Jensen-Shannon distances (square roots of divergences in bits, 0 to 1). A text with
    fewer than ``min_chars`` characters or ``min_words`` words is too short for the histogram concerned, which then
    says nothing.
    """

    references: dict[str, LanguageReference] = field(default_factory=lambda: REFERENCES)
    max_char_distance: float = 0.17
    max_word_distance: float = 0.33
    min_chars: int = 100
    min_words: int = 30


def _distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares that each sum to 1."""
    terms = F.zip_with(
        shares,
        reference,
        lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0),
    )
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    """The shares and, as one more class, what they leave of 1."""
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.concat(shares, F.array(F.greatest(rest, F.lit(0.0))))


def _repeated_words(windows: Column, ordered: Column) -> Column:
    """Words inside windows that occur twice or more.

    ``ordered`` holds (hash, start) of every window in order, so equal windows are neighbours there.
    """
    last = F.size(ordered) - 1
    repeated = F.array_sort(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), last),
                lambda j: ((j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == ordered[j]["h"]))
                | ((j < last) & (ordered[F.least(j + 1, last)]["h"] == ordered[j]["h"])),
            ),
            lambda j: ordered[j]["at"],
        )
    )
    return F.when(F.size(ordered) > 0, repeated).otherwise(F.array().cast("array<int>"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to ``docs``, and ``_q_words``.

    Words are runs of characters other than ASCII white space. A null text counts as an empty one: all counts are
    0. Nothing is shuffled: every count is an expression over one row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    words = F.col("_q_words")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    df = df.withColumns({"n_words": F.size(words).cast("long"), "_q_lines": lines})
    # A 64-bit hash stands for a window; within one text two different windows agree with odds of about n^2 / 2^65.
    windows = F.when(
        F.col("n_words") >= 5,
        F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(words[i + k] for k in range(5)))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_q_windows", windows)
    windows = F.col("_q_windows")
    # Most texts repeat nothing; only the others pay for the sort.
    ordered = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    df = df.withColumn("_q_ordered", ordered)
    df = df.withColumn("_q_repeated", _repeated_words(windows, F.col("_q_ordered")))
    at = F.col("_q_repeated")
    covered = F.aggregate(
        F.when(F.size(at) > 1, F.sequence(F.lit(1), F.size(at) - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(5),
        lambda n, i: n + F.least(F.lit(5), at[i] - at[i - 1]),
    )
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(at) > 0, covered).otherwise(0).cast("long"),
        }
    ).drop("_q_lines", "_q_windows", "_q_ordered", "_q_repeated")


def divergences(docs: DataFrame, rules: QualityRules, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add char_distance and word_distance to the result of :func:`base_counts`, null where a text is too short.

    A text whose language is null or has no reference takes the smallest distance over all references.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words, n = F.col("_q_words"), F.col("n_words")
    df = docs.withColumns(
        {
            "_q_chars": F.length(t).cast("double"),
            "_q_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "_q_digit": F.regexp_count(t, F.lit(r"\p{Nd}")),
            "_q_punct": F.regexp_count(t, F.lit(r"[\p{P}&&[^#*%&]]")),
        }
    )
    size = F.col("_q_chars")
    counts = [size - F.col("word_chars"), F.col("_q_upper"), F.col("_q_digit"), F.col("_q_punct"), F.col("n_symbols")]
    # One histogram over the common words of all references serves every language.
    common = sorted({w for r in rules.references.values() for w in r.words})
    listed = F.array(*map(F.lit, common))
    found = F.filter(F.transform(words, lambda w: F.array_position(listed, F.lower(w)).cast("int")), lambda k: k > 0)
    df = df.withColumns({"_q_common": found, "_q_shares": _with_rest(F.array(*(c / F.greatest(size, F.lit(1.0)) for c in counts)))})
    hist = F.transform(F.sequence(F.lit(1), F.lit(len(common))), lambda k: F.size("_q_common") - F.size(F.array_remove("_q_common", k)))
    df = df.withColumn("_q_hist", hist)
    known = F.coalesce(F.col(lang).isin(list(rules.references)), F.lit(False))
    references = F.array(
        *(
            F.struct(
                F.lit(name).alias("lang"),
                F.array(*map(F.lit, r.chars)).alias("chars"),
                F.array(*(F.lit(common.index(w)) for w in r.words)).alias("at"),
                F.array(*map(F.lit, (*r.words.values(), 1 - sum(r.words.values())))).alias("words"),
            )
            for name, r in rules.references.items()
        )
    )
    compared = F.filter(references, lambda r: ~known | (r["lang"] == F.col(lang)))
    by_char = F.transform(compared, lambda r: _distance(F.col("_q_shares"), r["chars"]))
    by_word = F.transform(
        compared, lambda r: _distance(_with_rest(F.transform(r["at"], lambda k: F.get("_q_hist", k) / F.greatest(n, F.lit(1)))), r["words"])
    )
    return df.withColumns(
        {
            "char_distance": F.when(size >= rules.min_chars, F.array_min(by_char)),
            "word_distance": F.when(n >= rules.min_words, F.array_min(by_word)),
        }
    ).drop("_q_chars", "_q_upper", "_q_digit", "_q_punct", "_q_common", "_q_hist", "_q_shares")


def quality(docs: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the base counts, base_failed, both distances and ``kept``, one row per row of ``docs``.

    A text fails the base rules with fewer than 10 words, or with more than a fifth of its words in repeated
    windows; it fails the method's rules if a histogram is farther from its language's reference than the rules
    allow. Null and empty texts fail. Repeated rows get equal results; other columns pass through, except that
    columns named like the added ones are replaced and names that begin with ``_q_`` are reserved.
    """
    rules = rules or QualityRules()
    df = divergences(base_counts(docs, text), rules, text, lang).drop("_q_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.max_word_distance, F.lit(False)
    )
    # The row number, always true here, holds later filters above the counts: pushed below them, a condition would
    # repeat the expressions of each count inside those that build on it.
    here = F.monotonically_increasing_id() >= 0
    return df.withColumn("base_failed", failed).withColumn("kept", here & ~failed & ~far)
