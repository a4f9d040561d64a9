"""Opinions and syllabuses of courts as Column expressions: assembly, sections, evidence of what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5000
SYLLABUS = 8000
# Name, pattern in lower case, and what it says, from the most to the least specific.
DISPOSITIONS = (
    ("affirmed_in_part_reversed_in_part", r"\baffirmed\s+in\s+part[,\s]+(?:and\s+)?reversed\s+in\s+part\b", "other"),
    ("reversed_in_part_affirmed_in_part", r"\breversed\s+in\s+part[,\s]+(?:and\s+)?affirmed\s+in\s+part\b", "other"),
    ("reversed_and_remanded", r"\breversed\s+and\s+remanded\b", "reversed"),
    ("vacated_and_remanded", r"\bvacated\s+and\s+remanded\b", "vacated"),
    ("affirmed_and_remanded", r"\baffirmed\s+and\s+remanded\b", "affirmed"),
    ("judgment_affirmed", r"\bjudgment[^.]{0,30}(?:is\s+)?(?:hereby\s+)?affirmed\b", "affirmed"),
    ("judgment_reversed", r"\bjudgment[^.]{0,30}(?:is\s+)?(?:hereby\s+)?reversed\b", "reversed"),
    ("judgment_vacated", r"\bjudgment[^.]{0,30}(?:is\s+)?(?:hereby\s+)?vacated\b", "vacated"),
    ("judgment_remanded", r"\bjudgment[^.]{0,30}(?:is\s+)?(?:hereby\s+)?remanded\b", "remanded"),
    ("citation_reversed", r"\d+\s+[a-z]+\.?\s+(?:\d+[a-z]{2}\s+)?\d+,\s+reversed", "reversed"),
    ("citation_affirmed", r"\d+\s+[a-z]+\.?\s+(?:\d+[a-z]{2}\s+)?\d+,\s+affirmed", "affirmed"),
    ("citation_vacated", r"\d+\s+[a-z]+\.?\s+(?:\d+[a-z]{2}\s+)?\d+,\s+vacated", "vacated"),
    ("dismissed", r"\bdismissed\b", "dismissed"),
    ("granted", r"\b(?:petition|application)[^.]{0,20}(?:is\s+)?granted\b", "granted"),
    ("denied", r"\b(?:petition|application)[^.]{0,20}(?:is\s+)?denied\b", "denied"),
    ("affirmed", r"\baffirmed\b", "affirmed"),
    ("reversed", r"\breversed\b", "reversed"),
    ("vacated", r"\bvacated\b", "vacated"),
    ("remanded", r"\bremanded\b", "remanded"),
)
# Heads of the sections of an assembled opinion, in the order in which they stand.
SECTIONS = ("MAJORITY OPINION", "CONCURRENCE", "DISSENT", "OTHER")
# Where a syllabus begins and what ends it. The heading counts as it is written, the lines in any case.
SYLLABUS_BEGINS = r"(?s)^.+?SUPREME COURT.*?Syllabus.*?(?i:Decided\s+[A-Z][a-z]+\s+\d+,\s+\d{4}\s*\n)(.*)$"
JUSTICES = "THOMAS|ROBERTS|ALITO|SOTOMAYOR|KAGAN|GORSUCH|KAVANAUGH|BARRETT|JACKSON"
OPINION_BEGINS = (
    r"(?i)\n\s*(?:(?:CHIEF\s+)?JUSTICE\s+\w+\s+delivered\s+the\s+opinion|PER\s+CURIAM\.?\s*\n|Opinion\s+of\s+(?:the\s+Court|JUSTICE|\w+,\s*J\.)|\[\s*Footnote\s*\d)"
    rf"|\n\s{{4,}}(?:{JUSTICES}),?\s*J\."
)
DOCKET_BEGINS = r"(?i)No\.\s*\d+[–-]\d+\.[^\n]*?Decided[^\n]*?\d{4}\s*\n((?s:.*))$"
DOCKET_ENDS = r"(?i)\n\s*(?:CHIEF\s+)?JUSTICE\s+\w+\s+delivered|\n\s*PER\s+CURIAM"


def opinion_rank(kind: Column) -> Column:
    """0 for a majority or lead, 1 for a concurrence or statement, 2 for a dissent, 3 for others; a dissent is never anything else."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.contains("dissent"), 2).when(k.rlike("majority|lead|per.?curiam|combined|opinion.of.the.court"), 0).when(k.rlike("concur|statement"), 1).otherwise(3)


def assemble(opinions: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, text): the opinions of a case under heads, in the order of their ranks and ids; opinions without text are left out."""
    rank, author = opinion_rank(F.col("type")), F.coalesce("author", F.lit("Unknown"))
    head = (
        F.when(rank == 0, F.when(F.coalesce("author", F.lit("")) == "", F.lit(SECTIONS[0])).otherwise(F.concat(F.lit(SECTIONS[0] + " ("), "author", F.lit(")"))))
        .when(rank == 1, F.concat(F.lit(SECTIONS[1] + " ("), author, F.lit(")"))).when(rank == 2, F.concat(F.lit(SECTIONS[2] + " ("), author, F.lit(")")))
        .otherwise(F.concat(F.lit(SECTIONS[3] + " ("), author, F.lit(", type: "), F.coalesce("type", F.lit("null")), F.lit(")")))
    )
    parts = opinions.filter(F.coalesce("text", F.lit("")) != "").select(case, F.struct(rank.alias("rank"), "id", F.concat(F.lit("=== "), head, F.lit(" ===\n"), "text").alias("part")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    return parts.groupBy(case).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("text"))


def section(text: Column, name: str) -> Column:
    """What stands under the first head of ``name``, up to a head of another name; null without the head."""
    others = "|".join(s for s in SECTIONS if s != name)
    found = F.regexp_extract(text, rf"(?is)===\s*{name}[^=]*===(.*?)(?:===\s*(?:{others})[^=]*===|$)", 1)
    return F.when(text.rlike(rf"(?i)===\s*{name}[^=]*==="), F.trim(found))


def _one_line(c: Column) -> Column:
    """A passage without white space around it, its lines joined."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\n\s+", " "), r"\s{2,}", " ")


def syllabus_of(text: Column) -> Column:
    """The syllabus in a decision's text: what follows the Decided line after the heading, up to where an opinion or a justice's part begins, at most 5,000 characters.

    Without the heading, or if that has under 100 characters, what follows a docket number's Decided line: 100 to 5,000
    characters up to the opinion or the end; null otherwise.
    """
    body = F.when(~text.startswith("SUPREME COURT"), F.regexp_extract(text, SYLLABUS_BEGINS, 1))
    headed = _one_line(F.substring(F.split(body, OPINION_BEGINS, 2)[0], 1, 5000))
    rest = F.regexp_extract(text, DOCKET_BEGINS, 1)
    least = F.substring(rest, 1, 100)
    docket = F.concat(least, F.split(F.substring(rest, 101, 2**31 - 1), DOCKET_ENDS, 2)[0])
    return F.when(F.length(headed) >= 100, headed).when(F.length(docket).between(100, 5000), _one_line(docket))


def excerpt(text: Column, most: int = 15_000) -> Column:
    """The opinion's text from its first line of prose, if that is near the start."""
    before = F.regexp_extract(text, r"(?s)^(.{1,1999}?)\n\s*(?:The|This|In|Under|Petitioner|Respondent|Plaintiff|Defendant)", 1)
    return F.trim(F.substring(text, F.length(before) + 1, F.lit(most)))


def disposition(syllabus: Column, opinion: Column) -> Column:
    """Struct of disposition, source, window, pattern and raw: the first pattern in the first window that has any.

    Windows: the first and last characters of the syllabus, then of the majority's section, then all of that; never a
    concurrence or a dissent. Without a syllabus of over 100 characters, the majority's beginning stands in, or the text's.
    """
    short = F.when(F.length(F.trim(syllabus)) > 100, syllabus)
    once = F.array(F.struct(section(opinion, SECTIONS[0]).alias("majority"), short.alias("short"), opinion.alias("opinion")))

    def last(c: Column) -> Column:
        return F.substring(c, F.greatest(F.length(c) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))

    def windows(x: Column) -> Column:
        majority = x["majority"]
        head = F.coalesce(x["short"], F.substring(majority, 1, SYLLABUS), F.substring(x["opinion"], 1, SYLLABUS))
        cuts = [("syllabus", "first", F.substring(head, 1, WINDOW)), ("syllabus", "last", last(head)), ("majority", "first", F.substring(majority, 1, WINDOW)), ("majority", "last", last(majority)), ("majority", "full", majority)]
        return F.array(*(F.struct(F.lit(source).alias("source"), F.lit(window).alias("window"), F.lower(c).alias("text")) for source, window, c in cuts))

    def evidence(w: Column) -> Column:
        def hit(name: str, pattern: str, value: str) -> Column:
            raw = F.trim(F.regexp_replace(F.regexp_extract(w["text"], f"({pattern})", 1), r"\s+", " "))
            return F.when(w["text"].rlike(pattern), F.struct(F.lit(value).alias("disposition"), w["source"].alias("source"), w["window"].alias("window"), F.lit(name).alias("pattern"), raw.alias("raw")))

        return F.coalesce(*(hit(*d) for d in DISPOSITIONS))

    found = F.filter(F.transform(F.flatten(F.transform(once, windows)), evidence), lambda x: x.isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("disposition"), F.lit("unknown").alias("source"), F.lit("none").alias("window"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("raw"))
    return F.coalesce(F.get(found, F.lit(0)), none)
