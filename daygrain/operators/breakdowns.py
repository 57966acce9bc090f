"""Shares, thresholds, name matching and rolling means over estimate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions.numeric import ratio


def with_group_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys)))


def at_least_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows at or above an interpolated quantile taken over all rows."""
    threshold = df.agg(F.percentile(value, p)).scalar()
    return df.filter(F.col(value) >= threshold)


def share_and_score(df: DataFrame, key: str, value: str, weight: str, out: str, score: str) -> DataFrame:
    """Scale ``value`` to sum to one within ``key``, then score the key.

    The score is the mean of ``weight`` times the share, so the share comes first.
    """
    group = Window.partitionBy(key)
    return df.withColumn(out, ratio(F.col(value), F.sum(value).over(group))).withColumn(
        score, F.avg(F.col(weight) * F.col(out)).over(group)
    )


def with_overall_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """The mean over all rows on every row, without moving the rows to one task."""
    return df.withColumn(out, df.agg(F.avg(value)).scalar())


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = 7
) -> DataFrame:
    """Centred mean over ``width`` neighbouring rows; NULL where the window is cut off."""
    half = width // 2
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    whole = F.count(F.lit(1)).over(window) == width
    return df.withColumn(out, F.when(whole, F.avg(value).over(window)))


def one_per_case(df: DataFrame, columns: Sequence[str], key: str = "case_id") -> DataFrame:
    """Distinct values of household columns; a case with two different values is an error."""
    agreed = []
    for c in columns:
        low, high = F.min(c), F.max(c)
        clash = F.raise_error(F.concat(F.lit(f"conflicting {c} for case "), F.col(key).cast("string")))
        agreed.append(F.when(low != high, clash.cast(df.schema[c].dataType)).otherwise(low).alias(c))
    return df.groupBy(key).agg(*agreed)


# ---------------------------------------------------------------------------
# Matching by edit distance
# ---------------------------------------------------------------------------


def _shortened(text: Column, deletions: int) -> Column:
    """All texts left after removing up to ``deletions`` characters."""
    out = F.array(text)
    layer = out
    for _ in range(deletions):
        layer = F.array_distinct(
            F.flatten(
                F.transform(
                    layer,
                    lambda t: F.transform(
                        F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(
                            F.array().cast("array<int>")
                        ),
                        lambda i: F.concat(
                            F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))
                        ),
                    ),
                )
            )
        )
        out = F.array_union(out, layer)
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two texts, where swapping two neighbours is one edit and no place is edited twice.

    Row by row over the usual table; each row is built from the two before it.
    """
    first, second = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)

    def cell(i, j, row, above, two_above):
        x, y = F.get(first, i - 1), F.get(second, j - 1)
        swapped = (i > 1) & (j > 1) & (x == F.get(second, j - 2)) & (F.get(first, i - 2) == y)
        return F.least(
            F.get(row, j - 1) + 1,
            F.get(above, j) + 1,
            F.get(above, j - 1) + F.when(x == y, 0).otherwise(1),
            F.when(swapped, F.get(two_above, j - 2) + 1),
        )

    def next_row(state, i):
        def extended(row, j):
            return F.concat(row, F.array(cell(i, j, row, state["above"], state["two_above"])))

        row = F.aggregate(F.sequence(F.lit(1), m), F.array(i), extended)
        return F.struct(row.alias("above"), state["above"].alias("two_above"))

    top = F.sequence(F.lit(0), m)
    start = F.struct(top.alias("above"), top.alias("two_above"))
    table = F.aggregate(F.sequence(F.lit(1), n), start, next_row, lambda state: F.get(state["above"], m))
    return F.when((n == 0) | (m == 0), F.greatest(n, m)).otherwise(table)


def stringdist_left_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    max_distance: int = 2,
    best_only: bool = False,
) -> DataFrame:
    """Left join on case-sensitive edit distance; every match within the distance is kept.

    Two texts within d edits share a text that both reach by at most d deletions (a swap of two
    neighbours takes one in each), so the
    candidates come from an equi-join on those shortened texts and no pair outside it can
    match. The match runs on distinct names; rows meet their names afterwards.
    ``best_only`` keeps the closest names of each row.
    """
    names = left.select(F.col(left_on).alias("_name")).filter("_name is not null").distinct()
    others = right.select(F.col(right_on).alias("_other")).filter("_other is not null").distinct()
    a = names.select("_name", F.explode(_shortened(F.col("_name"), max_distance)).alias("_short"))
    b = others.select("_other", F.explode(_shortened(F.col("_other"), max_distance)).alias("_short"))
    pairs = (
        a.join(b, "_short")
        .select("_name", "_other")
        .distinct()
        .withColumn("distance", edit_distance(F.col("_name"), F.col("_other")))
        .filter(F.col("distance") <= max_distance)
    )
    if best_only:
        nearest = F.min("distance").over(Window.partitionBy("_name"))
        pairs = pairs.withColumn("_nearest", nearest).filter("distance = _nearest").drop("_nearest")
    matched = pairs.join(right, pairs["_other"] == right[right_on]).drop("_other")
    return left.join(matched, left[left_on] == matched["_name"], "left").drop("_name")
