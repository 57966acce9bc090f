"""Estimates straight from the wide summary file.

One row per respondent with ``TUCASEID``, a weight column and one ``tNNNNNN`` column of
minutes per activity code, or a ``WideTable`` with these columns as one array. Everything a person contributes is in one row, so the only
shuffle is the final one over groups x activities.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.operators import estimates, variance
from daygrain.operators.categorize import label_header, unique_mapping
from daygrain.operators.reshape import (
    WideTable,
    activity_names,
    columns_matching,
    complete,
    gathered,
    numbers,
    unpivot_cells,
)
from daygrain.sources.readers import ID_COLUMN, weight_column, without_missing

CELLS = "_cells"


def _totals(codes: Sequence[str], labels: Sequence[Sequence[str]]) -> Column:
    """The minutes of a row by label, each a list of codes, as an array; a missing value is an error."""
    cells, place = F.col(CELLS), {code: i for i, code in enumerate(codes)}

    def total(places: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda sum_, i: sum_ + F.get(cells, i))

    listed = F.array(*[numbers(place[c] for c in own) for own in labels])
    return F.transform(listed, lambda places: complete(total(places), cells, codes))


def _check(df: DataFrame | WideTable, groups, activities, simplify) -> tuple[DataFrame, str, list[str], list[str]]:
    """The rows with the chosen minutes as the array ``CELLS``, the weight column, the groups and the codes."""
    data = df.data if isinstance(df, WideTable) else df
    listed = df.codes if isinstance(df, WideTable) else columns_matching(df)
    weight, groups = weight_column(data), estimates.group_list(groups)
    codes = list(dict.fromkeys(activities)) if activities is not None else list(listed)
    known = listed if isinstance(df, WideTable) else df.columns
    missing = [*(c for c in groups if c not in data.columns), *(c for c in codes if c not in known)]
    if missing:
        raise ValueError(f"data has no column {', '.join(missing)}")
    if not codes:
        raise ValueError("no activity columns to estimate")
    if isinstance(simplify, DataFrame):
        if set(simplify.columns) != {"activity", "description"}:
            raise ValueError("simplify must have the columns 'activity' and 'description'")
    elif simplify not in (None, True, False) and not all(len(pair) == 2 for pair in simplify):
        raise ValueError("simplify must be True, (activity, description) pairs or a DataFrame")
    cells = df.chosen(codes) if isinstance(df, WideTable) else gathered(codes)
    rows = without_missing(data, [weight]).select(ID_COLUMN, weight, *groups, cells.alias(CELLS))
    return rows, weight, groups, codes


def _cells(df, weight, groups, codes, by_label: dict[str | None, list[str]]) -> DataFrame:
    """Weighted sums per (label, group); every person has a row for every label, zeros included."""
    totals = _totals(codes, list(by_label.values()))
    labels = F.array(*[F.lit(label).cast("string") for label in by_label])
    people = df.select(
        *groups, F.col(weight).alias("weight"), F.posexplode(totals).alias("_place", "minutes")
    ).withColumn("activity", F.get(labels, F.col("_place")))
    return people.groupBy("activity", *groups).agg(
        F.sum("weight").alias("total_weight"),
        F.sum(F.col("weight") * F.col("minutes")).alias("weighted_sum"),
        F.sum(F.when(F.col("minutes") > 0, F.col("weight")).otherwise(0.0)).alias("participant_weight"),
    )


def _by_pairs(pairs, codes) -> dict[str | None, list[str]]:
    given = [code for code, _ in pairs]
    twice = {code for code in given if given.count(code) > 1}
    if twice:
        raise ValueError(f"activity listed more than once: {', '.join(sorted(twice))}")
    described = dict(pairs)
    out: dict[str | None, list[str]] = {}
    for code in codes:
        out.setdefault(described.get(code), []).append(code)
    return out


def get_min_per_part(df: DataFrame | WideTable, groups=None, activities=None, simplify=None) -> DataFrame:
    """Weighted minutes, participation rate and minutes per participant.

    ``simplify`` collapses activities: ``True`` to a single row, ``(activity, description)``
    pairs or a DataFrame of them to the descriptions.
    """
    df, weight, groups, codes = _check(df, groups, activities, simplify)
    if simplify is True:
        cells = _cells(df, weight, groups, codes, {estimates.COLLAPSED_LABEL: codes})
        return estimates.metrics_from_cells(cells, groups)
    if simplify is not None and simplify is not False and not isinstance(simplify, DataFrame):
        cells = _cells(df, weight, groups, codes, _by_pairs(list(simplify), codes))
        return estimates.metrics_from_cells(cells, groups)
    people = df.select(ID_COLUMN, F.col(weight).alias("weight"), *groups, CELLS)
    fact = unpivot_cells(people, [ID_COLUMN, "weight", *groups], F.col(CELLS), codes, check=True)
    listed = activity_names(codes)
    if isinstance(simplify, DataFrame):
        mapping = unique_mapping(simplify).filter(F.col("activity").isin(codes))
        by_person = [ID_COLUMN, "weight", *groups]
        fact = (
            fact.join(F.broadcast(mapping), "activity", "left")
            .groupBy("description", *by_person)
            .agg(F.sum("minutes").alias("minutes"))
            .withColumnRenamed("description", "activity")
        )
        described = df.sparkSession.createDataFrame([(c,) for c in codes], "activity string").join(
            F.broadcast(mapping), "activity", "left"
        )
        listed = described.agg(F.collect_set(F.struct("description"))).scalar()["description"]
    totals = people.groupBy(*groups).agg(F.sum("weight").alias("total_weight"))
    return estimates.metrics_from_cells(estimates.cells_from_rows(fact, totals, groups, listed), groups)


def get_minutes(df: DataFrame | WideTable, groups=None, activities=None, simplify=None) -> DataFrame:
    """Weighted mean minutes per day by activity and group."""
    out = get_min_per_part(df, groups, activities, simplify)
    return out.select("activity", *estimates.group_list(groups), "weighted_minutes")


def get_participation(df: DataFrame | WideTable, groups=None, activities=None, simplify=None) -> DataFrame:
    """Weighted share of people who spent any time in the activity."""
    out = get_min_per_part(df, groups, activities, simplify)
    return out.select("activity", *estimates.group_list(groups), "participation_rate")


def apply_weights(df: DataFrame | WideTable, groups, activities=None) -> DataFrame:
    warnings.warn("apply_weights is deprecated, use get_minutes", DeprecationWarning, stacklevel=2)
    return get_minutes(df, groups, activities)


def get_SE(df: DataFrame | WideTable, replicate_weights: DataFrame, groups, activities=None) -> DataFrame:
    """Weighted minutes over the activities with their replicate-weight standard error.

    ``replicate_weights`` holds ``TUCASEID`` and one column per replicate. Rows meet by
    case, so ``df`` may be filtered or in any order.
    """
    df, weight, groups, codes = _check(df, groups, activities, True)
    people = df.select(
        F.col(ID_COLUMN).alias("case_id"),
        F.col(weight).cast("double").alias("weight"),
        *groups,
        F.get(_totals(codes, [codes]), F.lit(0)).alias("minutes"),
    )
    weights = replicate_weights.select(
        F.col(ID_COLUMN).alias("case_id"), *[F.col(c).cast("double") for c in replicate_weights.columns if c != ID_COLUMN]
    )
    return variance.replicate_se_of_columns(people, weights, groups)


def add_work_status(df: DataFrame | WideTable, threshold: float = 120, code: str = "t05") -> DataFrame:
    """Flag rows whose minutes in the columns containing ``code`` reach the threshold."""
    wide = isinstance(df, WideTable)
    codes = [c for c in df.codes if code in c] if wide else columns_matching(df, code)
    data, cells = (df.data, df.chosen(codes)) if wide else (df, gathered(codes))
    return data.withColumn("work_status", F.aggregate(cells, F.lit(0.0), lambda total, x: total + x) >= threshold)


def descriptions(df: DataFrame | WideTable, patterns=None) -> list[tuple[str, str | None]]:
    """(activity, category) of every activity column, from the header alone."""
    names = df.codes if isinstance(df, WideTable) else columns_matching(df)
    return label_header(names) if patterns is None else label_header(names, patterns)
