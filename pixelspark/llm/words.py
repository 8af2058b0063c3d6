"""Words of a text in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words for licence scans and decontamination.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters untouched; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_array(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def placed_words(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each word of each text, and a last one with a null word.

    Returns ``id``, ``key`` (a hash of the text, so that rows of one id with other texts stay
    apart), ``n`` words, ``words`` (the whole array, by reference), ``pos`` from 0 and ``word``.
    The row with the null word stands for the text itself, also where it has no words.
    """
    text = F.col(text_col)
    arrays = rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), word_array(text).alias("words"))
    return arrays.select("id", "key", F.size("words").alias("n"), "words", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "word"))
