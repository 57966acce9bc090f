"""Line dedup by overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import stored

BLANK = " \t\r"


def _solid_lines(text: Column) -> Column:
    """The non-blank lines of a text: line number and two independent 64-bit hashes."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    solid = F.filter(lines, lambda x: F.trim(x["line"], F.lit(BLANK)) != "")
    return F.transform(
        solid,
        lambda x: F.struct(
            x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("g")
        ),
    )


def line_windows(keyed: DataFrame, text: str, size: int) -> DataFrame:
    """One row per run of ``size`` consecutive non-blank lines: key columns, ``first``, ``last``, ``h``, ``g``."""
    keys = [c for c in keyed.columns if c != text]
    solid = keyed.select(*keys, _solid_lines(F.col(text)).alias("_solid"))
    # a text with fewer lines has no window
    runs = F.size("_solid") - (size - 1)
    shifted = [
        F.slice("_solid", F.lit(k + 1), F.when(runs > 0, runs).otherwise(0)).alias(f"_l{k}") for k in range(size)
    ]
    zipped = solid.select(*keys, *shifted).select(*keys, F.explode(F.arrays_zip(*[f"_l{k}" for k in range(size)])))
    return zipped.select(
        *keys,
        F.col("col._l0.at").alias("first"),
        F.col(f"col._l{size - 1}.at").alias("last"),
        F.xxhash64(*[f"col._l{k}.h" for k in range(size)]).alias("h"),
        F.xxhash64(*[f"col._l{k}.g" for k in range(size)]).alias("g"),
    )


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3) -> DataFrame:
    """All rows and columns of ``df`` with the text cleaned, and the columns ``n_lines`` and ``n_removed``.

    Every run of ``size`` consecutive non-blank lines is a window, identified by 128 hash bits. A window
    that occurs several times in the corpus stays where it occurs first, by id (null ids last), then text,
    then line; the lines under all its later occurrences go, with blank lines inside a window. Overlapping
    windows cover their lines together. Every removed line has an equal line that stays at an earlier place.

    A null text stays null, with no lines; a text of fewer than ``size`` non-blank lines is not changed.
    Rows with the same id and the same text are one document, so that each of them gets the result of the
    first. An empty input gives an empty result. Columns of ``df`` named ``n_lines`` or ``n_removed`` are
    replaced; others are returned as they are, whatever their names.
    """
    keyed = df.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_body"), F.col(text).alias("_text")
    )
    windows = line_windows(keyed, "_text", size)
    place = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_body"), F.col("first"))
    repeated = stored(
        windows.groupBy("h", "g")
        .agg(F.min(place).alias("origin"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h", "g", "origin")
    )
    covered = stored(
        windows.join(repeated, ["h", "g"])
        .where(place > F.col("origin"))
        .groupBy("_id", "_body")
        .agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
        .select(
            "_id",
            "_body",
            F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["first"], s["last"])))).alias(
                "_covered"
            ),
        )
    )
    kept_columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    body = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"),
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.col(text)).alias("_body"),
    ).alias("d")
    joined = body.join(
        covered.alias("c"),
        F.col("d._id").eqNullSafe(F.col("c._id")) & (F.col("d._body") == F.col("c._body")),
        "left",
    ).select("_row", "_covered", F.split(F.col("_row")[text], "\n", -1).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    cleaned = F.concat_ws("\n", F.transform(left, lambda i: F.element_at(F.col("_lines"), i + 1)))
    return joined.select(
        *[
            (F.when(F.col("_covered").isNull(), F.col("_row")[c]).otherwise(cleaned) if c == text else F.col("_row")[c])
            .alias(c)
            for c in kept_columns
        ],
        F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).alias("n_removed"),
    )
