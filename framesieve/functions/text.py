"""Lexical evidence."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore, and the code points from U+00C0 to U+1EF9 (fixed value).
TOKEN = r"[\p{L}\p{N}_À-ỹ]+"
#: Keys whose values a JSON document's text is made of (fixed values).
TEXT_KEYS = ("label", "name", "class", "category", "description", "caption", "title", "text")


def tokens(text: Column) -> Column:
    """The set of words longer than one character, lower-cased, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower))


def overlap(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document has; 0 where either has none.  Takes token arrays."""
    return F.when((F.size(query) == 0) | (F.size(document) == 0), 0.0).otherwise(F.size(F.array_intersect(query, document)) / F.size(query))


def lexical_overlap(query: Column, document: Column) -> Column:
    return overlap(tokens(query), tokens(document))


def task_type(query_id: Column) -> Column:
    low = F.lower(query_id)
    return F.when(low.startswith("trake"), "TRAKE").when(low.startswith("qa"), "QA").when(low.startswith("tkis"), "TKIS").otherwise("UNKNOWN")


def has_prefix(column: Column, prefixes: list[str]) -> Column:
    """Whether any prefix fits; no prefixes admit all."""
    fits = F.lit(not prefixes)
    for p in prefixes:
        fits = fits | column.startswith(p)
    return fits


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


#: What a video-language model is told before a question (fixed value).
INSTRUCTION = "Answer the question using only the provided video frames. Be concise and do not invent details.\n\nQuestion: "


def prompt(question: str) -> str:
    return INSTRUCTION + question
