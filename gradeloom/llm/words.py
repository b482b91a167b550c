"""Word expressions shared by the operators: a word is a run of characters other than ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space as characters and as a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def word_count(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")
