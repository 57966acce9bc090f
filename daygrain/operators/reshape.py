"""Wide <-> long."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVITY_COLUMN = "^t[0-9]"
NAME_SEPARATOR = "\x1f"  # in no column name


def columns_matching(df: DataFrame, pattern: str = ACTIVITY_COLUMN) -> list[str]:
    """Column names that contain a regular expression, in file order."""
    return [c for c in df.columns if re.search(pattern, c)]


def activity_names(activities: Sequence[str]) -> Column:
    """The column names as one constant array; written as one text, as a file can have hundreds of them."""
    return F.split(F.lit(NAME_SEPARATOR.join(activities)), NAME_SEPARATOR)


@dataclass(frozen=True)
class WideTable:
    """A wide file with its activity columns as one array, so that plans have one column for hundreds of them.

    ``codes`` are the names in the header, in the order of the array column ``cells``; ``data`` has the other columns.
    """

    data: DataFrame
    codes: tuple[str, ...]
    cells: str = "cells"

    def chosen(self, codes: Sequence[str]) -> Column:
        """The minutes of some codes, as an array in their order.

        The row's array is bound to a variable: in a function called per code its expression would be computed per code.
        """
        if tuple(codes) == self.codes:
            return F.col(self.cells)
        place = {code: i for i, code in enumerate(self.codes)}
        chosen, cells = numbers(place[c] for c in codes), F.col(self.cells)
        bound = F.transform(F.array(cells), lambda row: F.transform(chosen, lambda i: F.get(row, i)))
        # named twice, the array is computed beforehand, in generated code
        return F.when(cells.isNotNull(), F.get(bound, F.lit(0))).otherwise(
            F.array_repeat(F.lit(None).cast("double"), len(codes))
        )


def numbers(values: Iterable[int]) -> Column:
    """A constant array of whole numbers; written as one text, as it can be long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def gathered(activities: Sequence[str]) -> Column:
    """The minutes of a row of separate columns as one array."""
    return F.array(*activities).cast("array<double>")


def complete(value: Column, cells: Column, activities: Sequence[str]) -> Column:
    """``value``, which is NULL only if one of the ``cells`` is; that is an error with the activity's name."""
    empty = F.filter(numbers(range(len(activities))), lambda i: F.get(cells, i).isNull())
    name = F.get(activity_names(activities), F.get(empty, 0))
    missing = F.raise_error(F.concat(F.lit("missing value in "), name))
    return F.coalesce(value, missing.cast("double"))


def unpivot_cells(df: DataFrame, ids: Sequence[str], cells: Column, activities: Sequence[str], check: bool) -> DataFrame:
    """One row per (row, activity) with time spent, from an array; zero cells are left out.

    They are dropped where the array is exploded, in the same generated code; the name of a cell is looked up by its
    place. With ``check`` a missing value is an error.
    """
    names = activity_names(activities)
    minutes = F.col("minutes")
    if check:
        missing = F.raise_error(F.concat(F.lit("missing value in "), F.get(names, F.col("_place"))))
        minutes = F.when(minutes.isNotNull(), minutes).otherwise(missing.cast("double"))
    return (
        df.select(*ids, F.posexplode(cells).alias("_place", "minutes"))
        .filter(minutes > 0)
        .select(*ids, F.get(names, F.col("_place")).alias("activity"), "minutes")
    )


def unpivot_activities(
    df: DataFrame | WideTable, ids: Sequence[str], activities: Sequence[str] | None = None, complete: bool = False
) -> DataFrame:
    """One row per (row, activity) with time spent; by default of all activities of the header."""
    if isinstance(df, WideTable):
        codes = df.codes if activities is None else activities
        return unpivot_cells(df.data, ids, df.chosen(codes), codes, complete)
    codes = columns_matching(df) if activities is None else activities
    return unpivot_cells(df, ids, gathered(codes), codes, complete)


def metrics_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns as (name, value) rows, chosen by name."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in metrics], "name", "value")


def pivot_values(
    df: DataFrame, keys: Sequence[str], column: str, values: Sequence, metrics: Mapping[str, str]
) -> DataFrame:
    """Spread the listed values of one column; ``metrics`` maps value column to name suffix.

    An empty suffix names the new column after the value alone.
    """
    aggregates = [
        F.max(F.when(F.col(column) == F.lit(v), F.col(m))).alias(f"{v}{suffix}")
        for m, suffix in metrics.items()
        for v in values
    ]
    return df.groupBy(*keys).agg(*aggregates)
