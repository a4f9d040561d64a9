"""Full-text search: terms, phrases of terms, OR and minus, over vectors of stems."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T


def light_stem(word: str) -> str:
    """The stem that :func:`weftline.functions.text.stem` gives."""
    if len(word) > 4:
        word = re.sub("ies$", "y", word)
    if len(word) > 3 and not word.endswith("ss"):
        word = re.sub("s$", "", word)
    return re.sub("(ing|ed)$", "", word) if len(word) > 5 else word


def matches(vector: Column, text: str) -> Column:
    """All terms of one of the alternatives between OR are in the vector, and none after a minus. Quoted words are all terms."""

    def term(word: str) -> Column:
        parts = re.findall("[a-z0-9]+", word.lower())
        found = reduce(Column.__and__, [F.array_contains(vector, light_stem(p)) for p in parts], F.lit(True))
        return ~found if word.startswith("-") and parts else found

    alternatives = [re.findall(r'-?"[^"]*"|\S+', part) for part in re.split(r"\s+OR\s+", text.strip())]
    return reduce(Column.__or__, [reduce(Column.__and__, map(term, words), F.lit(True)) for words in alternatives])


def phrase_vector(c: Column) -> Column:
    """Stems of a text's words in their order, between blanks: terms and phrases are looked for as they stand there."""
    return F.concat(F.lit(" "), F.array_join(F.transform(T.tokens(c), T.stem), " "), F.lit(" "))


def websearch(vector: Column, text: str) -> Column:
    """The web grammar over :func:`phrase_vector`: all terms of an alternative between OR, quoted words next to each other, none after a minus.

    Terms are stemmed as the vector's words are. A search without terms finds nothing.
    """

    def term(word: str) -> Column:
        parts = [light_stem(p) for p in re.findall("[a-z0-9]+", word.lower())]
        found = vector.contains(f" {' '.join(parts)} ") if parts else F.lit(True)
        return ~found if word.startswith("-") and parts else found

    alternatives = [re.findall(r'-?"[^"]*"|\S+', part) for part in re.split(r"\s+OR\s+", text.strip())]
    asked = [reduce(Column.__and__, map(term, words)) for words in alternatives if re.search("[A-Za-z0-9]", " ".join(words))]
    return reduce(Column.__or__, asked, F.lit(False))
