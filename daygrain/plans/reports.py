"""The tables behind the published summaries and charts.

Every report takes a ``Survey`` and returns a DataFrame. Nothing is rounded here except
where the printed table itself is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain import lookups
from daygrain.functions import clock, labels
from daygrain.functions.numeric import hours
from daygrain.operators import breakdowns, categorize, demographics as demo, diary, profile, trends, variance
from daygrain.operators.estimates import (
    METRICS,
    participation,
    per_participant,
    person_slots,
    weighted_minutes,
)
from daygrain.operators.reshape import metrics_long, pivot_values
from daygrain.session import cut_lineage
from daygrain.survey import Survey

AGE_BREAKS = (20, 40, 60, 100)
AGE_LABELS = ("Age 20-40", "40-60", "60+")
INCOME_BREAKS = (0, 50000, 100000, 150000)
INCOME_LABELS = ("$0-50k", "$50-100k", "$100-150k")
LOW_SHARE = 0.30  # quantile below which rare activities are left out
SECURITY_OUTLIER_YEAR = 2011


# ---------------------------------------------------------------------------
# Summaries by sex and category
# ---------------------------------------------------------------------------


def summary_by_sex(s: Survey) -> DataFrame:
    """Hours, participation and hours per participant by category and sex."""
    est = per_participant(
        s.respondents, s.minutes, ["sex"], simplify=categorize.CURATED
    )
    return est.select(
        "activity",
        labels.sex_label(F.col("sex")).alias("sex"),
        hours(F.col("weighted_minutes")).alias("weighted_hours"),
        F.round("participation_rate", 4).alias("participation_rate"),
        hours(F.col("minutes_per_participant")).alias("hours_per_participant"),
    )


def hours_with_sexes_as_columns(s: Survey) -> DataFrame:
    est = weighted_minutes(
        s.respondents, s.minutes, ["sex"], simplify=categorize.CURATED
    ).select(
        "activity",
        labels.sex_label(F.col("sex")).alias("sex"),
        hours(F.col("weighted_minutes")).alias("weighted_hours"),
    )
    return pivot_values(est, ["activity"], "sex", ["Male", "Female"], {"weighted_hours": ""})


def summary_with_sexes_as_columns(s: Survey) -> DataFrame:
    """All three printed metrics spread over the sexes."""
    metrics = ("weighted_hours", "participation_rate", "hours_per_participant")
    return pivot_values(
        summary_by_sex(s), ["activity"], "sex", ["Male", "Female"], {m: f"_{m}" for m in metrics}
    )


def category_totals_by(s: Survey, respondents: DataFrame, groups: Sequence[str], work_day: bool = False) -> DataFrame:
    """Weighted minutes per category, data-quality codes left out.

    The sum of a category's weighted means is the weighted mean of its sum, so the codes
    are added up per person first and one slot per category reaches the aggregation.
    """
    est = weighted_minutes(
        respondents,
        s.minutes,
        groups,
        simplify=categorize.WITHOUT_DATA_CODES,
        work_day=s.work_day if work_day else None,
    )
    return est.withColumnRenamed("activity", "description")


def category_by_sex(s: Survey) -> DataFrame:
    out = category_totals_by(s, s.respondents, ["sex"])
    return out.withColumn("sex", labels.sex_label(F.col("sex")))


# ---------------------------------------------------------------------------
# Television
# ---------------------------------------------------------------------------


def tv_by_age_sex(s: Survey) -> DataFrame:
    est = weighted_minutes(
        s.respondents, s.minutes, ["age", "sex"], activities=lookups.TV_CODES, simplify=True
    )
    return est.withColumn("sex", labels.sex_label(F.col("sex")))


def tv_cubic(s: Survey) -> DataFrame:
    points = tv_by_age_sex(s).select("age", "sex", "weighted_minutes")
    return trends.cubic_trend(points, ["sex"], "age", "weighted_minutes")


def tv_by_age_wide(s: Survey) -> DataFrame:
    """Age, both sexes and their smoothed series, as written for the interactive chart."""
    long = trends.loess_trend(
        tv_by_age_sex(s).select("age", "sex", "weighted_minutes"), ["sex"], "age", "weighted_minutes"
    )
    return pivot_values(long, ["age"], "sex", ["Male", "Female"], {"weighted_minutes": "", "trend": "_smooth"})


def tv_sex_gap(s: Survey) -> DataFrame:
    """Gap between the sexes per age with the durations as printed next to the chart."""
    est = tv_by_age_sex(s)
    wide = pivot_values(est, ["age"], "sex", ["Male", "Female"], {"weighted_minutes": ""})
    return wide.withColumn("gap", F.col("Male") - F.col("Female"))


def tv_formatted(s: Survey) -> DataFrame:
    minutes = F.col("weighted_minutes")
    return tv_by_age_sex(s).select(
        "age",
        "sex",
        clock.hours_minutes_truncated(minutes).alias("axis_label"),
        clock.hours_minutes_rounded(minutes).alias("clock_label"),
        clock.duration_in_words(minutes).alias("words"),
    )


def tv_standard_errors(s: Survey) -> DataFrame:
    est = variance.standard_errors(
        s.respondents,
        s.minutes,
        s.replicate_weights,
        ["age", "sex"],
        lookups.TV_CODES,
        s.replicates,
    )
    return variance.with_band(est).withColumn("sex", labels.sex_label(F.col("sex")))


def age_extent(s: Survey) -> DataFrame:
    return profile.extent(s.respondents, "age")


# ---------------------------------------------------------------------------
# Metrics in long form
# ---------------------------------------------------------------------------


def _long(est: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    long = metrics_long(est, ids, metrics)
    return long.withColumn("name", labels.metric_label(F.col("name")))


def _by_sex_year_agebin(s: Survey, activities) -> DataFrame:
    rank = labels.bin_rank(F.col("age"), AGE_BREAKS)
    people = s.respondents.filter(F.col("age") > 20).withColumn("age_rank", rank)
    est = per_participant(
        people, s.minutes, ["sex", "year", "age_rank"], activities=activities, simplify=True
    )
    est = est.select(
        labels.sex_label(F.col("sex")).alias("sex"),
        "year",
        labels.bin_label(F.col("age_rank"), AGE_LABELS).alias("age_group"),
        *METRICS[:2],
    )
    long = _long(est, ["sex", "year", "age_group"], METRICS[:2])
    return long.withColumn("grouping", F.concat("sex", F.lit("-"), "age_group"))


def household_by_sex_year_agebin(s: Survey) -> DataFrame:
    codes = categorize.CURATED.among(F.col("activity"), "^Household Activities$")
    return _by_sex_year_agebin(s, codes)


def cooking_grocery_by_sex_year_agebin(s: Survey) -> DataFrame:
    return _by_sex_year_agebin(s, lookups.COOKING_CODES + lookups.GROCERY_CODES)


def _by_year(s: Survey, activities, people: DataFrame | None = None) -> DataFrame:
    people = s.respondents if people is None else people
    est = per_participant(people, s.minutes, ["year"], activities=activities, simplify=True)
    return est


def work_by_year(s: Survey) -> DataFrame:
    codes = categorize.CURATED.among(F.col("activity"), "Work")
    return _long(_by_year(s, codes), ["activity", "year"])


def job_search_by_year(s: Survey) -> DataFrame:
    return _long(_by_year(s, lookups.JOB_SEARCH_CODES), ["activity", "year"])


def garden_by_year(s: Survey) -> DataFrame:
    """Garden, lawn and houseplants among people aged 20 to 40."""
    codes = categorize.codes_named(s.names(), "gard")
    people = s.respondents.filter((F.col("age") >= 20) & (F.col("age") <= 40))
    return _long(_by_year(s, codes, people), ["activity", "year"])


def security_by_year(s: Survey, outlier: int = SECURITY_OUTLIER_YEAR) -> DataFrame:
    codes = categorize.codes_named(s.names(), "secu", exclude=["Home security"])
    return _by_year(s, codes).filter(F.col("year") != outlier)


def _by_sex_age(s: Survey, activities) -> DataFrame:
    est = per_participant(s.respondents, s.minutes, ["sex", "age"], activities=activities, simplify=True)
    est = est.withColumn("sex", labels.sex_label(F.col("sex")))
    return _long(est, ["activity", "sex", "age"])


def cooking_by_sex_age(s: Survey) -> DataFrame:
    return _by_sex_age(s, lookups.COOKING_CODES)


def grocery_by_sex_age(s: Survey) -> DataFrame:
    return _by_sex_age(s, lookups.GROCERY_CODES)


def leisure_standard_errors(s: Survey) -> DataFrame:
    codes = categorize.codes_named(s.names(), "leisure")
    est = variance.standard_errors(
        s.respondents, s.minutes, s.replicate_weights, ["year"], codes, s.replicates
    )
    return variance.with_band(est)


def with_trend(report, groups: Sequence[str], x: str, y: str = "value"):
    """The same report with the smoothed value of every series, as its chart draws it."""

    def smoothed(s: Survey) -> DataFrame:
        return trends.loess_trend(report(s), groups, x, y)

    return smoothed


household_trend = with_trend(household_by_sex_year_agebin, ["grouping", "name"], "year")
cooking_grocery_trend = with_trend(cooking_grocery_by_sex_year_agebin, ["grouping", "name"], "year")
work_trend = with_trend(work_by_year, ["name"], "year")
job_search_trend = with_trend(job_search_by_year, ["name"], "year")
garden_trend = with_trend(garden_by_year, ["name"], "year")
security_trend = with_trend(security_by_year, ["activity"], "year", "minutes_per_participant")
cooking_trend = with_trend(cooking_by_sex_age, ["sex", "name"], "age")
grocery_trend = with_trend(grocery_by_sex_age, ["sex", "name"], "age")


# ---------------------------------------------------------------------------
# Work days
# ---------------------------------------------------------------------------


def category_by_age_workday(s: Survey) -> DataFrame:
    est = weighted_minutes(
        s.respondents,
        s.minutes,
        ["age", "work_day"],
        simplify=categorize.CURATED,
        work_day=s.work_day,
    )
    return est.withColumn("work_day", labels.work_day_label(F.col("work_day")))


def home_activities_by_age_workday(s: Survey) -> DataFrame:
    return category_by_age_workday(s).filter(F.col("activity").isin(*lookups.HOME_CATEGORIES))


def _workday_spline(est: DataFrame) -> DataFrame:
    return trends.spline_trend(est, ["activity", "work_day"], "age", "weighted_minutes")


def home_activities_spline(s: Survey) -> DataFrame:
    return _workday_spline(home_activities_by_age_workday(s))


def category_spline(s: Survey) -> DataFrame:
    return _workday_spline(category_by_age_workday(s))


# ---------------------------------------------------------------------------
# Income
# ---------------------------------------------------------------------------


def _with_bracket(s: Survey) -> DataFrame:
    """Respondents with a known income, in five wide brackets."""
    floors = lookups.income_floors(s.respondents.sparkSession)
    return (
        s.respondents.join(s.incomes(), "case_id", "left")
        .filter(F.col("income_code") != -1)
        .withColumn("income_code", labels.bracket_code(F.col("income_code")))
        .join(F.broadcast(floors), "income_code", "left")
        .drop("income_code")
    )


def _with_income(s: Survey) -> DataFrame:
    floors = lookups.income_floors(s.respondents.sparkSession)
    return s.respondents.join(s.incomes(), "case_id", "left").join(
        F.broadcast(floors), "income_code", "left"
    )


def _named(est: DataFrame, s: Survey) -> DataFrame:
    names = s.names().select(
        F.concat(F.lit("t"), F.col("code")).alias("activity"), "description"
    )
    return est.join(F.broadcast(names), "activity", "left")


def _income_label(df: DataFrame) -> DataFrame:
    brackets = lookups.income_brackets(df.sparkSession)
    return df.join(F.broadcast(brackets), "hh_income", "left")


def _shares(est: DataFrame, value: str, s: Survey, drop_nec: bool) -> DataFrame:
    # a few rows per activity that the quantile and the shares both read
    est = cut_lineage(est.select("activity", "hh_income", value))
    totalled = breakdowns.with_group_total(est, ["activity"], value, "total")
    kept = _named(breakdowns.at_least_quantile(totalled, "total", LOW_SHARE), s)
    if drop_nec:
        kept = kept.filter(categorize.without_nec(F.col("description")))
    scored = breakdowns.share_and_score(kept, "activity", value, "hh_income", "share", "mean_income")
    return _income_label(scored).select(
        "activity", "description", "hh_income", "income_label", "income_rank", "share", "mean_income"
    )


def _ordered(df: DataFrame) -> DataFrame:
    """Chart order: activities of richer households first, brackets from high to low."""
    return df.orderBy(F.desc("mean_income"), "activity", F.desc("income_rank"))


def sports_share_by_income(s: Survey) -> DataFrame:
    minutes = s.minutes.filter(F.col("activity").between(*lookups.SPORTS_CODE_RANGE))
    codes = None if s.codes is None else s.codes.filter(F.col("activity").between(*lookups.SPORTS_CODE_RANGE))
    est = participation(_with_bracket(s), minutes, ["hh_income"], unique_minutes=s.unique_minutes, codes=codes)
    return _ordered(_shares(est, "participation_rate", s, drop_nec=True))


def _waiting(s: Survey) -> dict[str, DataFrame | None]:
    """Minutes of the waiting activities, and their codes if the survey lists its codes."""
    named = categorize.codes_named(s.names(), "wait")
    return {
        "minutes": categorize.keep_codes(s.minutes, named),
        "codes": None if s.codes is None else categorize.keep_codes(s.codes, named),
    }


def waiting_share_by_income(s: Survey) -> DataFrame:
    est = weighted_minutes(_with_bracket(s), groups=["hh_income"], **_waiting(s))
    out = _shares(est, "weighted_minutes", s, drop_nec=True)
    short = F.concat(F.lit("... "), labels.without_waiting_prefix(F.col("description")))
    return _ordered(out.withColumn("description", short))


def waiting_share_participants(s: Survey) -> DataFrame:
    est = per_participant(
        _with_bracket(s), groups=["hh_income"], unique_minutes=s.unique_minutes, **_waiting(s)
    )
    out = _shares(est, "minutes_per_participant", s, drop_nec=False)
    short = labels.sentence_case(labels.without_waiting_prefix(F.col("description")))
    return _ordered(out.withColumn("description", short))


def category_by_income(s: Survey) -> DataFrame:
    return category_totals_by(s, _with_income(s), ["hh_income"])


def category_by_incomebin_age(s: Survey) -> DataFrame:
    """Work days only; respondents without a known income are left out."""
    rank = labels.bin_rank(F.col("hh_income"), INCOME_BREAKS, include_lowest=True)
    people = _with_income(s).withColumn("income_rank", rank)
    est = category_totals_by(s, people, ["income_rank", "age", "work_day"], work_day=True)
    return (
        est.filter("work_day")
        .drop("work_day")
        .dropna("any")
        .withColumn("income_label", labels.bin_label(F.col("income_rank"), INCOME_LABELS))
    )


def income_age_spline(s: Survey) -> DataFrame:
    return trends.spline_trend(
        category_by_incomebin_age(s), ["description", "income_rank"], "age", "weighted_minutes"
    )


# ---------------------------------------------------------------------------
# States
# ---------------------------------------------------------------------------


def leisure_by_state(s: Survey) -> DataFrame:
    """Leisure minutes per named state; numbers without a name are left out."""
    codes = categorize.codes_named(s.names(), "leisure")
    people = s.respondents.join(s.case_states, "case_id", "left")
    est = weighted_minutes(people, s.minutes, ["state_id"], activities=codes, simplify=True)
    names = s.state_names.select("state_id", "name")
    return (
        est.select("state_id", F.col("weighted_minutes").alias("total_leisure"))
        .join(names, "state_id", "left")
        .dropna("any")
    )


def leisure_by_state_region(s: Survey) -> DataFrame:
    regions = s.state_names.select("name", "region")
    out = cut_lineage(leisure_by_state(s)).join(regions, "name", "left")
    return breakdowns.with_overall_mean(out, "total_leisure", "mean_leisure").orderBy(
        "total_leisure", "name"
    )


def states_on_map(s: Survey, map_names: DataFrame, best_only: bool = False) -> DataFrame:
    """Leisure per state next to every map name (column ``region_name``) spelled nearly alike."""
    return breakdowns.stringdist_left_join(
        cut_lineage(leisure_by_state(s)), map_names, "name", "region_name", best_only=best_only
    )


# ---------------------------------------------------------------------------
# Computer use
# ---------------------------------------------------------------------------


def computer_use_by_age_year(s: Survey) -> DataFrame:
    est = weighted_minutes(
        s.respondents, s.minutes, ["age", "year"], activities=[lookups.COMPUTER_LEISURE_CODE], simplify=True
    )
    return est.select("age", "year", F.col("weighted_minutes").alias("total_minutes"))


def computer_use_rolling(s: Survey, width: int = 7) -> DataFrame:
    return breakdowns.rolling_mean(
        computer_use_by_age_year(s), ["year"], "age", "total_minutes", "rolling", width
    )


def computer_use_loess(s: Survey) -> DataFrame:
    return trends.loess_trend(computer_use_by_age_year(s), ["year"], "age", "total_minutes")


# ---------------------------------------------------------------------------
# Inputs of the clustering and sequence analyses
# ---------------------------------------------------------------------------


def code_catalogue(s: Survey) -> DataFrame:
    est = per_participant(s.respondents, s.minutes, unique_minutes=s.unique_minutes, codes=s.codes)
    return categorize.code_catalogue(
        est,
        lookups.CATEGORIES_V2,
        s.names(),
        lookups.tier1_names(s.minutes.sparkSession),
    )


def weekend_minutes_long(s: Survey) -> DataFrame:
    """Minutes per category of every weekend, non-holiday respondent, zeros included.

    A person has a row for every category, as in the wide file. Time under unknown codes is a
    category without a name, which everyone has if anyone spent time on it.
    """
    labelling = categorize.CURATED_V2
    people = diary.select_days(s.respondents, diary.WEEKEND).select("case_id")
    slots = person_slots(s.minutes, labelling)
    known = [(i, x) for i, x in enumerate(labelling.labels) if x is not None]
    entries = [
        F.struct(F.lit(x).alias("description"), F.coalesce(F.col(f"minutes_{i}"), F.lit(0.0)).alias("minutes"))
        for i, x in known
    ]
    unmapped = F.coalesce(F.col(f"minutes_{len(known)}"), F.lit(0.0))
    rest = F.struct(F.lit(None).cast("string").alias("description"), unmapped.alias("minutes"))
    used = slots.agg(F.max(f"minutes_{len(known)}")).scalar()
    rows = F.when(used > 0, F.array(*entries, rest)).otherwise(F.array(*entries))
    return people.join(slots, "case_id", "left").select("case_id", F.inline(rows))


def weekday_cases(s: Survey) -> DataFrame:
    return diary.select_days(s.diary_days, diary.WEEKDAYS).select("case_id")


def weekday_sequence(s: Survey) -> DataFrame:
    """Half-hour sequences of weekday diaries by the five-minute rule."""
    spells = diary.five_minute_spells(s.spells)
    return diary.five_minute_sequence(spells, s.diary_labels, weekday_cases(s))


def weekday_slots(s: Survey) -> DataFrame:
    spells = diary.five_minute_spells(s.spells)
    return diary.five_minute_slots(spells, s.diary_labels, weekday_cases(s))


def weekday_slots_complete(s: Survey) -> DataFrame:
    return diary.complete_slots(weekday_slots(s))


def whole_day_cases(s: Survey) -> DataFrame:
    return diary.whole_day_cases(diary.one_minute_spells(s.spells))


def whole_day_sequence(s: Survey) -> DataFrame:
    """Half-hour sequences of all complete diaries by the one-minute rule."""
    spells = diary.one_minute_spells(s.spells)
    return diary.one_minute_sequence(spells, s.diary_labels, whole_days=True)


def demographics_weekend(s: Survey) -> DataFrame:
    population = diary.select_days(s.respondents, diary.WEEKEND)
    return demo.demographics(s.respondents, s.roster, population)


def demographics_weekday(s: Survey) -> DataFrame:
    return demo.demographics(s.respondents, s.roster, weekday_sequence(s))


def demographics_full(s: Survey) -> DataFrame:
    # a complete diary has a sequence as soon as one described spell lasts a minute
    spells = diary.one_minute_spells(s.spells)
    lasting = F.col("description").isNotNull() & (F.col("start_min") < F.col("end_min"))
    population = (
        spells.groupBy("case_id")
        .agg(F.max("end_min").alias("last"), F.max(lasting).alias("lasting"))
        .filter((F.col("last") == clock.DAY) & F.col("lasting"))
    )
    return demo.demographics(s.respondents, s.roster, population, s.diary_days, s.diary_columns)


def demographics_profile(s: Survey) -> DataFrame:
    return profile.column_profile(demographics_weekend(s))
