"""Text and dates of raw pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text isn't part of an article.
ASIDE = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}


class _Text(HTMLParser):
    """Collects what stands in paragraphs outside of asides."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.aside, self.inside, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.aside += tag in ASIDE
        self.inside += tag == "p"

    def handle_endtag(self, tag):
        if tag in ASIDE:
            self.aside = max(0, self.aside - 1)
        if tag == "p":
            self.inside = max(0, self.inside - 1)
            self.parts.append("\n")

    def handle_data(self, data):
        if self.inside and not self.aside:
            self.parts.append(data)


def paragraphs(html: str | None) -> str:
    if not html:
        return ""
    reader = _Text()
    reader.feed(html)
    reader.close()
    return "\n".join(line for part in "".join(reader.parts).split("\n") if (line := " ".join(part.split())))


@F.pandas_udf(T.StringType())
def paragraph_text(html: pd.Series) -> pd.Series:
    return html.map(paragraphs)


def main_text(pages: DataFrame, least: int = 300, most: int = 5000) -> DataFrame:
    """page_id, method, text: paragraphs if they are long enough, else a container's stripped text, else nothing."""
    container = F.regexp_extract("html", r"(?is)<(?:article|main|body)[^>]*>(.*?)</(?:article|main|body)>", 1)
    stripped = F.trim(F.regexp_replace(F.regexp_replace(container, r"(?is)<(script|style|nav)[^>]*>.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    df = pages.select("page_id", paragraph_text("html").alias("paragraphs"), F.coalesce(stripped, F.lit("")).alias("stripped"))
    method = F.when(F.length("paragraphs") >= least, "paragraphs").when(F.length("stripped") >= least, "container").otherwise("none")
    text = F.when(F.length("paragraphs") >= least, F.col("paragraphs")).when(F.length("stripped") >= least, F.col("stripped")).otherwise("")
    return df.select("page_id", method.alias("method"), F.substring(text, 1, most).alias("text"))


# Where a page states its date, first valid one counts.
DATE_PATTERNS = (r'(?i)"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', r'(?i)<time[^>]+datetime="(\d{4}-\d{2}-\d{2})', r"(\d{4}-\d{2}-\d{2})")


def publication_dates(pages: DataFrame) -> DataFrame:
    """page_id and the date of publication, from the page's markup or its URL, between 2000 and 2030."""
    found = [F.try_to_date(F.regexp_extract("html", p, 1), "yyyy-MM-dd") for p in DATE_PATTERNS]
    found.append(F.try_to_date(F.replace(F.regexp_extract("url", r"/(\d{4}/\d{2}/\d{2})/", 1), F.lit("/"), F.lit("-")), "yyyy-MM-dd"))
    day = F.coalesce(*found)
    return pages.select("page_id", F.when(F.year(day).between(2000, 2030), F.date_format(day, "yyyy-MM-dd")).alias("published"))


def clemency_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, name, clemency_type, granted, source_key) of tables under dated headings; headings whose date can't be read give none.

    A heading is a date and counts of what was granted; rows have four cells or more. The key is made of the name in lower case and the date.
    """
    parts = F.slice(F.split(html, "(?i)<h3[^>]*>"), F.lit(2), F.lit(2**30))
    p = pages.select("page_id", F.explode(parts).alias("part")).select("page_id", F.regexp_extract("part", "(?is)^(.*?)</h3>", 1).alias("head"), "part")
    kind = F.when(F.lower("head").contains("commutation"), "commutation").when(F.lower("head").rlike("pre-?emptive"), "pre_emptive").otherwise("pardon")
    date = F.trim(F.regexp_replace("head", r"(?i)\s*-\s*\d+\s*(pardon|commutation)s?(\s*\(amended\))?(\s+and\s+\d+\s*(pardon|commutation)s?)?", ""))
    day = F.try_to_timestamp(date, F.lit("MMMM d, yyyy")).cast("date")
    rows = p.select("page_id", kind.alias("clemency_type"), F.date_format(day, "yyyy-MM-dd").alias("granted"), F.explode(F.regexp_extract_all("part", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row")).filter("granted is not null")
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") >= 4)
    name = F.get("cells", F.lit(0))
    key = F.substring(F.sha2(F.concat(F.lower(name), F.lit("|"), F.col("granted")), 256), 1, 16)
    return rows.select("page_id", name.alias("name"), "clemency_type", "granted", key.alias("source_key"))


def headline_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, title, url, url_hash) of linked headings of 20 characters or more, once per page and link."""
    found = F.regexp_extract_all(html, F.lit("(?is)<h[23][^>]*>\\s*(<a[^>]*href=.*?</a>)\\s*</h[23]>"), F.lit(1))
    a = pages.select("page_id", F.explode(F.array_distinct(found)).alias("a"))
    a = a.select("page_id", F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", ""), r"\s+", " ")).alias("title"), F.regexp_extract("a", """(?i)href=["']([^"']*)["']""", 1).alias("url"))
    return a.filter((F.length("title") >= 20) & (F.col("url") != "")).withColumn("url_hash", F.sha2("url", 256)).distinct()
