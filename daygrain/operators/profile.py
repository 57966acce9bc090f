"""Column frequency tables and extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, with_null: bool = True) -> DataFrame:
    """How often every value of every column occurs, missing values included."""
    columns = list(columns or df.columns)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    rows = df.select(F.inline(cells))
    if not with_null:
        rows = rows.filter("value is not null")
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))
