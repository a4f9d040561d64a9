"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between the words of a lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, and a sentence of the public text of the license, or one that states it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "this software is licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
)
#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class LicenseScan:
    """Templates as (label, sentence), phrases as (phrase, label), the share of a template's distinct words that a block
    must hold, and the lines that a block runs over."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    containment: float = 0.8
    lines: int = 4

    def tokens(self) -> list[str]:
        return sorted({t for _, sentence in self.templates for t in sentence.split()})

    def prepared(self, order: list[str]) -> tuple[list[tuple], list[tuple]]:
        """Templates as (number, label, tokens in order, least overlap), and their prefixes as (token, number, place, size, least)."""
        templates, prefixes = [], []
        for number, (label, sentence) in enumerate(self.templates):
            tokens = sorted({*sentence.split()}, key=order.index)
            least = math.ceil(self.containment * len(tokens) - 1e-9)
            templates.append((number, label, tokens, least))
            prefixes += [(t, number, k, len(tokens), least) for k, t in enumerate(tokens[: len(tokens) - least + 1])]
        return templates, prefixes


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z, with an empty one where the text begins or ends between words.

    ``lower`` also changes other letters, but of those only the Kelvin sign becomes an ASCII letter by itself, and
    words end at the same places; it is much faster than translating letter by letter.
    """
    return F.split(F.lower(text), BETWEEN)


def token_frequencies(docs: DataFrame, tokens: list[str], text: str = "text") -> list[str]:
    """``tokens`` from the rarest to the most frequent in all texts; equal counts go by the token."""
    counts = docs.select(F.explode(words_of(F.col(text))).alias("token")).filter(F.col("token").isin(tokens)).groupBy("token").count()
    # One row per token of the templates, whatever the corpus.
    counted = {r["token"]: r["count"] for r in counts.collect()}
    return sorted(tokens, key=lambda t: (counted.get(t, 0), t))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Indexes in ``words`` where the words of ``phrase`` stand one after another."""

    def stands(i: Column) -> Column:
        at = words[i] == phrase[0]
        for j, part in enumerate(phrase[1:], 1):
            at &= words[i + j] == part
        return at

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), stands)
    return F.when(F.size(words) >= len(phrase), starts).otherwise(F.array().cast("array<int>"))


def matching_blocks(docs: DataFrame, scan: LicenseScan, order: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """Every block and template with a containment of at least ``scan.containment``: keys, line, label, containment.

    A block is a line, its number from 0, with the ``scan.lines`` - 1 lines after it, so a sentence that is wrapped over
    so many lines is in one; what one line holds, its block holds. A block whose first line has no word of a
    template is left out, as the next one holds as much.

    ``order`` holds the tokens of all templates by their frequency in all texts. A block's tokens that no template
    holds would stand first and match nothing, so a block is reduced to those that stand in the order. Of a template
    with s tokens, r = ceil(containment * s) must be in the block: so one of the template's first s - r + 1 tokens is
    (prefix filter), among the block's first v - r + 1 of v (length filter v >= r); and from the first token in
    common, at least r must be left on both sides (positional filter). What is left is counted exactly.
    """
    templates, prefixes = scan.prepared(order)
    spark = docs.sparkSession
    # Both tables are as small as the templates, which are parameters.
    prefix = F.broadcast(spark.createDataFrame(prefixes, "token string, template int, at int, tokens int, least int"))
    whole = F.broadcast(spark.createDataFrame(templates, "template int, label string, words array<string>, needed int"))
    listed = F.array(*map(F.lit, order))
    lines = docs.select(*keys, F.transform(F.split(text, "\n"), lambda line: F.array_intersect(words_of(line), listed)).alias("lines"))
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: F.size(F.get("lines", k - 1)) > 0)
    blocks = lines.select(*keys, "lines", F.explode(starts).alias("at"))
    have = F.array_intersect(listed, F.flatten(F.slice("lines", F.col("at"), F.lit(scan.lines))))
    least_tokens = min(p[4] for p in prefixes)
    blocks = blocks.select(*keys, (F.col("at") - 1).alias("line"), have.alias("have")).filter(F.size("have") >= least_tokens)
    first = blocks.select("*", F.posexplode("have").alias("p", "token")).join(prefix, "token")
    held, least = F.size("have"), F.col("least")
    first = first.filter(
        (held >= least) & (F.col("p") <= held - least) & (F.least(held - F.col("p"), F.col("tokens") - F.col("at")) >= least)
    )
    pairs = first.select(*keys, "line", "have", "template").distinct().join(whole, "template")
    overlap = F.size(F.array_intersect("have", "words"))
    return pairs.filter(overlap >= F.col("needed")).select(*keys, "line", "label", (overlap / F.size("words")).alias("containment"))


def scan_licenses(docs: DataFrame, scan: LicenseScan | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Texts are lower-cased in A-Z only. n_base counts places where a phrase's words stand one after another;
    first_word and last_word are the smallest and largest of them, or null. base_labels come from the phrases, labels
    from the phrases and from blocks that hold a template; both are distinct, sorted and joined by commas, and empty
    if there is none. score is the greatest containment of a template, else 1 with a phrase and 0 without. A null
    text is empty. Rows that repeat get equal results. Texts aren't shuffled, only counts and blocks that match.
    """
    scan = scan or LicenseScan()
    order = token_frequencies(docs, scan.tokens(), text)
    prefix = sorted({p[0] for p in scan.prepared(order)[1]})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_text"), body.alias("_body"))
    rows = rows.withColumn("_words", words_of(F.col("_body")))
    df = rows.withColumn("n_words", F.size(F.array_remove("_words", "")).cast("long")).drop("_body")
    words = F.col("_words")
    places = {}
    for k, (phrase, _) in enumerate(scan.phrases):
        places[f"_p{k}"] = _starts(words, phrase.split())
    # A text that begins between words has an empty first one, which doesn't count as a place.
    df = df.withColumns({**places, "_before": F.when(words[0] == "", 1).otherwise(0)}).drop("_words")
    at = F.concat(*places)
    labels = [F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(places, scan.phrases, strict=True)]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    df = df.select(
        "doc_id", "_text", "n_words", F.size(at).cast("long").alias("n_base"),
        (F.array_min(at) - F.col("_before")).cast("long").alias("first_word"), (F.array_max(at) - F.col("_before")).cast("long").alias("last_word"), base.alias("_base"),
    )
    # A text that holds no token of any prefix can't hold a block that does.
    near = rows.filter(F.arrays_overlap("_words", F.array(*map(F.lit, prefix)))).drop("_words")
    blocks = matching_blocks(near, scan, order, ["doc_id", "_text"], "_body")
    found = blocks.groupBy("doc_id", "_text").agg(
        F.collect_set("label").alias("_found"), F.max("containment").alias("_best"), F.countDistinct("line").alias("_blocks")
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    df = df.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce("_best", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), F.coalesce("_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
