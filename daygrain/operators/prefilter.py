"""A filter of bounded size for rows whose key may be in another table, to be used before an exact semi join.

It is a table of bits by key hash: at most ``WORDS`` rows however many keys there are, so that it can be broadcast, and
rows are dropped where they lie. A dropped row has no partner for certain. With more than a few million keys more of the
others stay, up to all of them, and only the exact join decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 17  # of 64 bits


def _place(keys: Sequence[str]) -> tuple[Column, Column]:
    """The word and the bit of a key."""
    h = F.xxhash64(*keys)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def key_bits(wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bits of all keys: one row per used word, at most ``WORDS``."""
    word, bit = _place(keys)
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return wanted.select(word.alias("_word"), set_bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def with_bits(df: DataFrame, bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_bits``, the word that its key belongs to; NULL if no key has a bit there."""
    word, _ = _place(keys)
    return df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").drop("_word")


def marked(bits: Column, keys: Sequence[str]) -> Column:
    """Whether the bit of a row's key is set in its word."""
    _, bit = _place(keys)
    return F.coalesce(F.call_function("getbit", bits, bit) == 1, F.lit(False))


def among(df: DataFrame, bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key may be one of those that ``bits`` was made from."""
    word, _ = _place(keys)
    kept = df.withColumn("_word", word).join(F.broadcast(bits), "_word").filter(marked(F.col("_bits"), keys))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def possibly_in(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key may be in ``wanted``: all that are, and few others; null keys are keys like others."""
    return among(df, key_bits(wanted, keys), keys)
