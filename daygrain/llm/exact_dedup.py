"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import ascii_lower, stored
from daygrain.operators.prefilter import among, key_bits, marked, with_bits


def whole_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def exact_duplicates(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = (),
    prefix: int = 64,
    digest: str | None = None,
) -> DataFrame:
    """One row per input row: the id, the ``carry`` columns, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal if identical after lower-casing A-Z. Rows are first grouped by length, those that
    share a length by a hash of their first ``prefix`` characters, and only for rows that still share both
    is the whole text read and hashed; ``digest`` names a column that has :func:`whole_digest` already. No text is
    shuffled: from one step to the next a filter of bounded size marks the rows that go on, where they lie. It lets
    through all that share their key and few others, with more keys than it can tell apart up to all; these are
    alone in their group in the end. All groupings combine before the shuffle, and rows are matched to their group by
    joins that can split a large group over tasks.

    Null texts count as empty. Of equal texts the row with the largest id stays; null ids come after all
    others; of rows with the same id and text exactly one stays. An empty input gives an empty result.
    Other columns of ``df`` are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = df.select(
        F.col(doc_id).alias("_id"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
        (whole_digest(F.col(text)) if digest is None else F.col(digest)).alias("_whole"),
        F.octet_length(body).alias("_length"),
        F.xxhash64(ascii_lower(F.substring(body, 1, prefix))).alias("_prefix"),
    )

    def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)

    alike = ["_length", "_prefix"]
    narrow = stored(measured.select(*alike))
    lengths = stored(key_bits(shared(narrow, ["_length"]), ["_length"]))
    prefixes = stored(key_bits(shared(among(narrow, lengths, ["_length"]), alike), alike))
    whole = F.when(marked(F.col("_bits"), alike), F.col("_whole")).alias("_digest")
    rows = with_bits(measured, prefixes, alike).select(*[c for c in measured.columns if c not in ("_whole", "_prefix")], whole)
    rows = stored(rows.withColumn("_tie", F.monotonically_increasing_id()))
    survivors = rows.where(F.col("_digest").isNotNull())
    groups = stored(
        survivors.groupBy("_length", "_digest").agg(
            F.max(F.struct("_id", "_tie")).alias("_top"), F.count("*").alias("group_size")
        )
    )
    matched = survivors.join(groups, ["_length", "_digest"]).withColumn("kept", F.col("_tie") == F.col("_top._tie"))
    alone = rows.where(F.col("_digest").isNull())
    out = [F.col("_id").alias(doc_id), *[F.col(f"_carry_{c}").alias(c) for c in carry]]
    return matched.select(*out, F.col("_top._id").alias("keep_id"), "group_size", "kept").unionByName(
        alone.select(
            *out,
            F.col("_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
        )
    )
