"""Keys under which differently formatted texts are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_and_digits(text: Column) -> Column:
    """Lower-cased text without all characters but letters and digits; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def whitespace_key(text: Column) -> Column:
    """Trimmed text with each run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
