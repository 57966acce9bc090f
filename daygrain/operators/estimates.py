"""Survey-weighted minutes, participation rates and minutes per participant.

Two frames feed every estimate: ``respondents`` (one row per case with ``weight`` and the
grouping columns) and ``minutes`` (``case_id, activity, minutes``, positive minutes only).

Estimates over a short closed list of labels first shrink the fact to one row per case
with one slot per label. That needs a single shuffle on ``case_id``, combines on the map
side, lines up with the join to the respondents, and turns the zero cells and the
denominators into ordinary sums. Estimates per code keep the long form and take their
zero cells from codes x observed groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions.numeric import ratio, ratio_or_zero
from daygrain.operators.categorize import Labelling, distinct_codes, keep_codes, unique_mapping

# fixed value: label of the single row left by ``simplify=True`` (spelling included)
COLLAPSED_LABEL = "All activites provided"

METRICS = ("weighted_minutes", "participation_rate", "minutes_per_participant")


def group_list(groups: str | Sequence[str] | None) -> list[str]:
    """Group columns as a list; one column may be given as text."""
    return [groups] if isinstance(groups, str) else list(groups or [])


def _restrict(minutes: DataFrame, activities) -> DataFrame:
    if activities is None:
        return minutes
    if isinstance(activities, DataFrame):
        return keep_codes(minutes, activities)
    if isinstance(activities, Column):
        return minutes.filter(activities)
    return minutes.filter(F.col("activity").isin(list(activities)))


def metrics_from_cells(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Turn weighted sums into the three metrics."""
    return (
        cells.withColumn("weighted_minutes", ratio(F.col("weighted_sum"), F.col("total_weight")))
        .withColumn("participation_rate", ratio(F.col("participant_weight"), F.col("total_weight")))
        .withColumn(
            "minutes_per_participant",
            ratio_or_zero(F.col("weighted_minutes"), F.col("participation_rate")),
        )
        .select("activity", *groups, *METRICS)
    )


# ---------------------------------------------------------------------------
# Closed list of labels: one slot per label
# ---------------------------------------------------------------------------


def person_slots(
    minutes: DataFrame, labelling: Labelling | None, work_code: str | None = None
) -> DataFrame:
    """One row per case with the minutes of every label in a slot of its own.

    Without a labelling all rows share one slot. ``work_code`` adds the minutes of all codes
    that contain it, for the work-day flag, in the same pass.
    """
    hits = [F.lit(True)]
    if labelling is not None:
        minutes = minutes.withColumn("slot", labelling.slot(F.col("activity")))
        hits = [F.col("slot") == i for i in range(len(labelling.labels))]
    aggregates = [F.sum(F.when(hit, F.col("minutes"))).alias(f"minutes_{i}") for i, hit in enumerate(hits)]
    if work_code is not None:
        worked = F.when(F.col("activity").contains(work_code), F.col("minutes"))
        aggregates.append(F.sum(worked).alias("work_minutes"))
    return minutes.groupBy("case_id").agg(*aggregates)


def cells_from_slots(
    people: DataFrame, groups: Sequence[str], labels: Sequence[str | None]
) -> DataFrame:
    """Weighted sums per (label, group) from one row per person."""
    zero = F.lit(0.0)
    sums = [F.sum("weight").alias("total_weight")]
    for i in range(len(labels)):
        weighted = F.col("weight") * F.coalesce(F.col(f"minutes_{i}"), zero)
        sums.append(F.sum(weighted).alias(f"weighted_{i}"))
        # minutes are never negative, so a positive sum means some time was spent
        taking_part = F.when(F.col(f"minutes_{i}") > 0, F.col("weight")).otherwise(zero)
        sums.append(F.sum(taking_part).alias(f"taking_part_{i}"))
    slots = F.array(
        *[
            F.struct(
                F.lit(label).cast("string").alias("activity"),
                F.col(f"weighted_{i}").alias("weighted_sum"),
                F.col(f"taking_part_{i}").alias("participant_weight"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return (
        people.groupBy(*groups)
        .agg(*sums)
        .select(*groups, "total_weight", F.inline(slots))
    )


def keep_used_unmapped(df: DataFrame, label: str, value: str) -> DataFrame:
    """Drop the rows of the NULL label unless some unmapped code was used by anyone.

    The window holds the few rows of one label of an aggregated table.
    """
    used = F.max(value).over(Window.partitionBy(label)) > 0
    return df.withColumn("_used", used).filter(F.col(label).isNotNull() | F.col("_used")).drop("_used")


def _by_label(respondents, minutes, groups, labelling: Labelling, work_day) -> DataFrame:
    people = _people(respondents, minutes, labelling, work_day)
    cells = cells_from_slots(people, groups, labelling.labels)
    if labelling.unmapped:
        cells = keep_used_unmapped(cells, "activity", "weighted_sum")
    return metrics_from_cells(cells, groups)


def _people(respondents, fact, labelling, work_day) -> DataFrame:
    code, threshold = work_day if work_day else (None, None)
    people = respondents.join(person_slots(fact, labelling, code), "case_id", "left")
    if work_day:
        people = people.withColumn(
            "work_day", F.coalesce(F.col("work_minutes"), F.lit(0.0)) >= threshold
        )
    return people


# ---------------------------------------------------------------------------
# Open list of codes: long form
# ---------------------------------------------------------------------------


def _codes_array(minutes: DataFrame, activities, codes: DataFrame | None) -> Column:
    """All activities that need a row, as one small array: six-digit codes or a mapping's descriptions."""
    if codes is not None:
        return distinct_codes(codes).agg(F.collect_set("activity")).scalar()
    if isinstance(activities, (list, tuple)):
        return F.array(*[F.lit(a) for a in dict.fromkeys(activities)])
    # structs keep a NULL label, which a bare collect_set would lose
    listed = minutes.select("activity").distinct()
    return listed.agg(F.collect_set(F.struct("activity"))).scalar()["activity"]


def _sums(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    return rows.groupBy("activity", *groups).agg(
        F.sum(F.col("weight") * F.col("minutes")).alias("weighted_sum"),
        F.sum(F.when(F.col("minutes") > 0, F.col("weight")).otherwise(0.0)).alias("participant_weight"),
    )


def cells_from_rows(
    rows: DataFrame, totals: DataFrame, groups: Sequence[str], codes: Column
) -> DataFrame:
    """Weighted sums per (activity, group) from one row per person and activity.

    ``totals`` holds ``total_weight`` per group and ``codes`` the activities as an array.
    """
    sums = _sums(rows, groups)
    grid = totals.select(F.explode(codes).alias("activity"), *groups, "total_weight")
    # adding up the grid and the sums gives zero cells and keeps NULL groups without a join
    return (
        grid.unionByName(sums, allowMissingColumns=True)
        .groupBy("activity", *groups)
        .agg(
            F.max("total_weight").alias("total_weight"),
            F.coalesce(F.sum("weighted_sum"), F.lit(0.0)).alias("weighted_sum"),
            F.coalesce(F.sum("participant_weight"), F.lit(0.0)).alias("participant_weight"),
        )
    )


def _by_code(respondents, minutes, groups, activities, unique_minutes, codes=None) -> DataFrame:
    per_case = minutes
    if not unique_minutes:
        per_case = minutes.groupBy("case_id", "activity").agg(F.sum("minutes").alias("minutes"))
    rows = respondents.select("case_id", "weight", *groups).join(per_case, "case_id")
    totals = respondents.groupBy(*groups).agg(F.sum("weight").alias("total_weight"))
    if not groups and codes is None and not isinstance(activities, (list, tuple)):
        # every code that occurs has its one cell already
        cells = _sums(rows, groups).withColumn("total_weight", totals.scalar())
    else:
        cells = cells_from_rows(rows, totals, groups, _codes_array(minutes, activities, codes))
    return metrics_from_cells(cells, groups)


# ---------------------------------------------------------------------------
# Public estimates
# ---------------------------------------------------------------------------


def per_participant(
    respondents: DataFrame,
    minutes: DataFrame,
    groups: str | Sequence[str] | None = None,
    activities: Sequence[str] | Column | DataFrame | None = None,
    simplify: bool | Labelling | DataFrame | None = None,
    work_day: tuple[str, float] | None = None,
    unique_minutes: bool = False,
    codes: DataFrame | None = None,
    additive: bool = False,
) -> DataFrame:
    """All three metrics per activity and group in one pass over the fact.

    ``activities`` restricts the codes: a list, a predicate column or a one-column DataFrame.
    ``simplify`` collapses them: ``True`` to one row, a ``Labelling`` to its labels, a
    DataFrame ``(activity, description)`` to its descriptions. ``work_day=(code, minutes)`` adds a
    boolean column ``work_day`` to group by, read in the same pass.
    ``unique_minutes=True`` promises one row per (case, activity) and saves a shuffle.
    ``codes`` (column ``activity``) lists the codes that get a row, as a wide file's header does; by default
    these are the codes that occur in ``minutes``. ``additive=True`` is for callers that read the weighted
    minutes only: these are sums over the rows of a case, which then need not be brought together first.
    """
    groups = group_list(groups)
    if work_day is not None and activities is not None:
        raise ValueError("the work-day flag is read from all codes; filter the labels afterwards")
    wanted = _restrict(minutes, activities)
    if simplify is True:
        people = _people(respondents, wanted, None, work_day)
        return metrics_from_cells(cells_from_slots(people, groups, [COLLAPSED_LABEL]), groups)
    if isinstance(simplify, Labelling):
        return _by_label(respondents, wanted, groups, simplify, work_day)
    if work_day is not None:
        raise ValueError("work_day needs simplify=True or a Labelling")
    if isinstance(simplify, DataFrame):
        named = wanted.join(F.broadcast(unique_mapping(simplify)), "activity", "left")
        wanted = named.select("case_id", F.col("description").alias("activity"), "minutes")
        return _by_code(respondents, wanted, groups, None, additive)
    return _by_code(respondents, wanted, groups, activities, unique_minutes or additive, codes)


def weighted_minutes(respondents, minutes, groups=None, activities=None, simplify=None, **options) -> DataFrame:
    """Weighted mean minutes per activity and group."""
    out = per_participant(respondents, minutes, groups, activities, simplify, additive=True, **options)
    return out.select("activity", *group_list(groups), "weighted_minutes")


def participation(respondents, minutes, groups=None, activities=None, simplify=None, **options) -> DataFrame:
    """Weighted share of people with any time in the activity."""
    out = per_participant(respondents, minutes, groups, activities, simplify, **options)
    return out.select("activity", *group_list(groups), "participation_rate")
