"""Time diaries: clock spells to regular half-hour sequences.

A spell has ``case_id, ordinal, start_min, end_min, description`` with minutes counted from
4 am. Both rules shrink on the map side to a fixed number of cells per case, so neither a
long diary nor a hot case travels whole to one task. A selection of ``cases`` drops spells of
other cases before they expand by a filter of bounded size, where they lie; the exact semi
join then has the cells only.

The winner of a cell is found with a minimum or maximum over one packed integer: the
ranking value in the high bits, the position of the description in a short label list in
the low bits. Integers keep the aggregation in generated code without sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import clock
from daygrain.operators.prefilter import possibly_in

WEEKDAYS = (2, 3, 4, 5, 6)  # 1 is Sunday
WEEKEND = (1, 7)

PERIOD = 30  # minutes
SLOT = 5
SLOTS_PER_PERIOD = PERIOD // SLOT
# room for label positions in a packed integer; a longer label list is an error
LABEL_SPACE = 1 << 20


def select_days(days: DataFrame, which: Sequence[int], holidays: bool = False) -> DataFrame:
    """Diary days of the given weekdays, without holidays."""
    kept = days.filter(F.col("diary_day").isin(list(which)))
    return kept if holidays else kept.filter(F.col("holiday") == 0)


def normalise_spells(spells: DataFrame, step: int, cap: int) -> DataFrame:
    """Clock times to minutes after 4 am, floored to ``step``, wrapped spells cut at ``cap``."""
    start = clock.since_day_start(clock.floor_to(clock.minute_of_day(F.col("start_clock")), step))
    end = clock.since_day_start(clock.floor_to(clock.minute_of_day(F.col("stop_clock")), step))
    return (
        spells.withColumn("start_min", start)
        .withColumn("end_min", clock.cap_wrapped(F.col("start_min"), end, cap))
        .drop("start_clock", "stop_clock")
    )


def five_minute_spells(spells: DataFrame) -> DataFrame:
    return normalise_spells(spells, SLOT, clock.DAY - SLOT)


def one_minute_spells(spells: DataFrame) -> DataFrame:
    return normalise_spells(spells, 1, clock.DAY)


# ---------------------------------------------------------------------------
# Label lists
# ---------------------------------------------------------------------------


def _label_list(spells: DataFrame, labels: Sequence[str] | Column | None) -> Column:
    """The descriptions as one array.

    A closed list is given as text. Otherwise the list is an array column, usually a scalar
    subquery over the table the descriptions come from, and by default over the spells.
    """
    if labels is None:
        return described(spells, "description")
    if isinstance(labels, Column):
        return labels
    if len(labels) >= LABEL_SPACE:
        raise ValueError(f"the label list must be shorter than {LABEL_SPACE}")
    return F.array(*[F.lit(x) for x in labels])


def _numbered(spells: DataFrame, listed: Column) -> DataFrame:
    """The spells with ``label``: the 1-based position of the description, 0 if it is missing.

    The positions are looked up in a table by hash, which has fewer rows than ``LABEL_SPACE``; a description that is not
    in the list is an error.
    """
    one = spells.sparkSession.range(1).select(listed.alias("listed"))
    # a label that is listed twice has its first position
    numbers = one.select(F.posexplode("listed").alias("place", "description"))
    numbers = numbers.groupBy("description").agg((F.min("place") + 1).cast("long").alias("label"))
    unknown = F.raise_error(F.concat(F.lit("description not in the label list: "), F.col("description"))).cast("long")
    label = F.when(F.col("description").isNull(), F.lit(0).cast("long")).when(F.col("label").isNull(), unknown)
    named = spells.join(F.broadcast(numbers), "description", "left")
    return named.withColumn("label", label.otherwise(F.col("label")))


def described(df: DataFrame, column: str) -> Column:
    """All values of a category column as a sorted array subquery.

    Values are combined on the map side, and more of them than positions can number are an error.
    """
    listed = F.array_sort(F.collect_set(column))
    too_many = F.raise_error(F.lit(f"{column} has {LABEL_SPACE} or more different values")).cast("array<string>")
    return df.agg(F.when(F.size(listed) < LABEL_SPACE, listed).otherwise(too_many)).scalar()


def _only(df: DataFrame, cases: DataFrame | None) -> DataFrame:
    return df if cases is None else df.join(cases.select("case_id"), "case_id", "left_semi")


def _perhaps(spells: DataFrame, cases: DataFrame | None) -> DataFrame:
    return spells if cases is None else possibly_in(spells, cases, ["case_id"])


def _label(packed: Column, labels: Column) -> Column:
    at = (packed % F.lit(LABEL_SPACE)).cast("int")
    return F.when(at > 0, F.element_at(labels, at))


# ---------------------------------------------------------------------------
# Five-minute rule: closed intervals, the first spell that touches a slot keeps it
# ---------------------------------------------------------------------------


def _slots_by_period(spells: DataFrame, labels: Column) -> DataFrame:
    """Per (case, period) the winners of its slots in ``s0`` ... ``s5``; untouched slots are NULL.

    A spell becomes one row per period it touches, not one per slot.
    """
    start, end = F.col("start_min"), F.col("end_min")
    periods = F.sequence(clock.whole(start, PERIOD), clock.whole(end, PERIOD))
    touched = (
        _numbered(spells, labels)
        .select("case_id", "start_min", "end_min", (F.col("ordinal") * LABEL_SPACE + F.col("label")).alias("packed"))
        .select("case_id", "start_min", "end_min", "packed", F.explode(periods).alias("k"))
    )
    winners = []
    for i in range(SLOTS_PER_PERIOD):
        slot_start = F.col("k") * PERIOD + i * SLOT
        # both ends are multiples of a slot, and the end slot belongs to the spell
        inside = (start <= slot_start) & (end >= slot_start)
        winners.append(F.min(F.when(inside, F.col("packed"))).alias(f"s{i}"))
    return touched.groupBy("case_id", "k").agg(*winners)


def five_minute_slots(
    spells: DataFrame, labels: Sequence[str] | Column | None = None, cases: DataFrame | None = None
) -> DataFrame:
    """One row per case and touched five-minute slot (spells from ``five_minute_spells``)."""
    listed = _label_list(spells, labels)
    slots = F.array(*[f"s{i}" for i in range(SLOTS_PER_PERIOD)])
    return (
        _only(_slots_by_period(_perhaps(spells, cases), listed), cases)
        .select("case_id", "k", F.posexplode(slots).alias("i", "packed"))
        .filter("packed is not null")
        .select(
            "case_id",
            (F.col("k") * PERIOD + F.col("i") * SLOT).alias("minute"),
            _label(F.col("packed"), listed).alias("description"),
        )
    )


def complete_slots(slots: DataFrame) -> DataFrame:
    """All 288 slots of every case; untouched slots have no description.

    A case has at most 288 rows here, so its slots fit in one map.
    """
    known = slots.groupBy("case_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("minute", "description"))
        ).alias("known")
    )
    grid = F.sequence(F.lit(0), F.lit(clock.DAY - SLOT), F.lit(SLOT))
    return known.select("case_id", "known", F.explode(grid).alias("minute")).select(
        "case_id", "minute", F.try_element_at("known", F.col("minute")).alias("description")
    )


def _mode_of_slots(ids: Sequence[Column]) -> Column:
    """Most frequent of a few label positions; the earliest one wins a tie.

    Every described slot scores how many slots agree with it, then how early it is, and
    carries its label in the low bits; the greatest score is the mode.
    """
    n = len(ids)
    scored = []
    for i, mine in enumerate(ids):
        agreeing = sum((F.coalesce((mine == other).cast("long"), F.lit(0)) for other in ids), F.lit(0))
        score = (agreeing * n + (n - 1 - i)) * LABEL_SPACE + mine
        scored.append(F.when(mine > 0, score))
    return F.greatest(*scored)


def five_minute_sequence(
    spells: DataFrame, labels: Sequence[str] | Column | None = None, cases: DataFrame | None = None
) -> DataFrame:
    """The most frequent slot description of every half hour."""
    listed = _label_list(spells, labels)
    names = [f"s{i}" for i in range(SLOTS_PER_PERIOD)]
    sequence = (
        _slots_by_period(_perhaps(spells, cases), listed)
        .withColumns({s: F.col(s) % LABEL_SPACE for s in names})
        .filter(" or ".join(f"{s} > 0" for s in names))
        .select(
            "case_id",
            (F.col("k") + 1).alias("period"),
            F.element_at(listed, (_mode_of_slots([F.col(s) for s in names]) % LABEL_SPACE).cast("int")).alias(
                "description"
            ),
        )
    )
    return _only(sequence, cases)


# ---------------------------------------------------------------------------
# One-minute rule: half-open intervals, whole days only
# ---------------------------------------------------------------------------


def whole_day_cases(spells: DataFrame) -> DataFrame:
    """Cases whose diary reaches the end of the day (spells from ``one_minute_spells``)."""
    last = spells.groupBy("case_id").agg(F.max("end_min").alias("last"))
    return last.filter(F.col("last") == clock.DAY).select("case_id")


def one_minute_sequence(
    spells: DataFrame,
    labels: Sequence[str] | Column | None = None,
    cases: DataFrame | None = None,
    whole_days: bool = False,
) -> DataFrame:
    """The longest description of every half hour, without building the minutes.

    A half-open spell covers ``least(end) - greatest(start)`` minutes of each period it
    touches, which counts exactly the minutes a full grid would hold. ``whole_days`` keeps
    the diaries that reach the end of the day, known from the same pass.
    """
    listed = _label_list(spells, labels)
    start, end, k = F.col("start_min"), F.col("end_min"), F.col("k")
    covered = (
        _numbered(_perhaps(spells, cases).filter(start < end), listed)
        .select(
            "case_id",
            "start_min",
            "end_min",
            F.col("label").alias("id"),
            F.explode(F.sequence(clock.whole(start, PERIOD), clock.whole(end - 1, PERIOD))).alias("k"),
        )
        .withColumn("first", F.greatest(start, k * PERIOD))
        .withColumn("n", F.least(end, (k + 1) * PERIOD) - F.col("first"))
    )
    per_label = covered.groupBy("case_id", "k", "id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("end_min").alias("last")
    )
    # more minutes first, then the earlier start; minutes without description do not count
    packed = (F.col("n") * clock.DAY + (clock.DAY - 1 - F.col("first"))) * LABEL_SPACE + F.col("id")
    if whole_days:
        # the periods and the last minute of a case come from the same place
        per_label = per_label.repartition("case_id")
    periods = per_label.groupBy("case_id", "k").agg(
        F.max(F.when(F.col("id") > 0, packed)).alias("packed"), F.max("last").alias("last")
    )
    if whole_days:
        # a case has at most 48 rows here
        reached = F.max("last").over(Window.partitionBy("case_id"))
        periods = periods.withColumn("reached", reached).filter(F.col("reached") == clock.DAY)
    sequence = periods.filter("packed is not null").select(
        "case_id",
        (k + 1).alias("period"),
        F.element_at(listed, (F.col("packed") % LABEL_SPACE).cast("int")).alias("description"),
    )
    return _only(sequence, cases)
