"""Words of a text as Spark expressions.  A word is a match of ``[^\\x20\\x09-\\x0D]+``; null has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")
