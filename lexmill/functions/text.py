"""Text columns: code tokens, identifier terms, identifier words, set similarity, canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code tokenizer's alternatives, in order.
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|==|!=|<=|>=|//|\*\*|[+\-*/%<>]"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.]*"

# Words that are no search terms.
STOPWORDS = (
    "find code that which where what uses use using usages usage used calls call calling files file "
    "functions function methods method classes class before after with implementation implementations "
    "version versions history changed change between older previous show how this contains contain "
    "import imports importing references reference recursive recursion the a an and or to of in for is are"
).split()


def code_tokens(text: Column) -> Column:
    """Lower-cased identifiers, numbers and operators, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CODE_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(code_tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def query_terms(text: Column, limit: int = 12) -> Column:
    """Identifiers that aren't stopwords, case-sensitively distinct, the first `limit` of them.

    An identifier ends before a trailing dot and starts at a word boundary.
    """
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Za-z_][A-Za-z0-9_.]*\b"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, F.lower(w)))), 1, limit)


def identifier_words(name: Column) -> Column:
    """camelCase and snake_case names as lower-cased words joined by blanks."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    return F.lower(F.trim(F.regexp_replace(apart, r"\s+", " ")))


def plain_words(text: Column) -> Column:
    """Text in which only a-z, 0-9 and single blanks are left."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def text_fingerprint(text: Column) -> Column:
    """sha256 of the text with white space collapsed; for text that isn't code."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 256)


def short_fingerprint(fingerprint: Column, digits: int = 12) -> Column:
    """What a report shows of a fingerprint."""
    return F.substring(fingerprint, 1, digits)


def preview(text: Column, most: int = 500) -> Column:
    """The first characters of a text, for people to read."""
    return F.substring(text, 1, most)
