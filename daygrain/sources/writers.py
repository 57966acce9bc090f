"""Result tables as text or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header; missing values print as ``NA``."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
