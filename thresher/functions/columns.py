"""Column expressions shared by all operators. Everything here runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NORMAL = "normal"

# The characters that separate tokens (every character for which
# a Unicode-aware split on whitespace splits), as a regex class body.
SPACE_CLASS = (r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACES = f"[{SPACE_CLASS}]+"
TOKEN = f"[^{SPACE_CLASS}]+"

# Fixed value: a bag-of-words term is a run of at least two word characters.
TERM = r"[\p{L}\p{N}_]{2,}"

FLOATING = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def present(c: str | Column, dtype: T.DataType) -> Column:
    """Neither NULL nor NaN; Spark orders NaN above every number."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) if isinstance(dtype, FLOATING) else c.isNotNull()


def tokens(text: str | Column) -> Column:
    """All whitespace-separated tokens, in order."""
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def leading_parts(text: str | Column, n: int) -> Column:
    """The first ``n`` tokens, plus at least one element more if there are more tokens.

    The split stops there, so a long text is not tokenised to its end only to
    keep its first words. Only space at either end gives an empty element.
    """
    return F.array_remove(F.split(col(text), SPACES, n + 2), "")


def passes_unchanged(text: str | Column) -> Column:
    """Missing, empty and topic-free text is never cut."""
    text = col(text)
    return text.isNull() | (text == "") | (text == NORMAL)


def topic_tokens(text: str | Column) -> Column:
    """Topics of a topic text: none for missing, empty or ``normal`` text."""
    return (F.when(passes_unchanged(text), F.array().cast("array<string>"))
            .otherwise(tokens(text)))


def topic_count(text: str | Column) -> Column:
    return F.when(passes_unchanged(text), F.lit(0)).otherwise(F.size(tokens(text)))


def terms(text: str | Column) -> Column:
    """Bag-of-words terms in order, repeats kept."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))


def distinct_terms(text: str | Column) -> Column:
    return F.array_distinct(terms(text))


def as_text(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is 0 on an empty denominator."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
