"""Text columns: the tokenizer, cleaning of keys, document strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around a key: space, tab, line feed, carriage return, no-break space.
BLANKS = " \t\n\r\u00a0"


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits of the lower-cased text; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """Number of tokens as BIGINT: the runs are counted by their first characters, no array is built."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+")).cast("bigint")


def stripped(text: Column) -> Column:
    """The text without blanks around it."""
    return F.btrim(text, F.lit(BLANKS))


def clean_key(text: Column) -> Column:
    """A key compared without case and surrounding blanks."""
    return F.lower(stripped(text))


def semantic_text(title: Column, text: Column) -> Column:
    """`title. text`, without blanks around it; missing parts are empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit(""))))


def lexical_text(title: Column, text: Column) -> Column:
    """`title text`, without blanks around it; missing parts are empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
