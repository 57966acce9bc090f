"""Queries registered in ``__spark_entry__``: one per operator or report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from daygrain import api, lookups
from daygrain.functions import labels
from daygrain.operators import categorize, diary, reshape, variance
from daygrain.operators.estimates import participation, per_participant, weighted_minutes
from daygrain.plans import reports
from daygrain.testbed import tables

PLACES = 6

# the wide form has the minutes of every code, as the summary file does
WIDE_CODES = tuple(f"t{code}" for code in tables.CODES)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of summation does not show."""
    return df.select(
        *[
            F.round(f.name, PLACES).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _report(function, *needed: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(tables.survey(spark, sf_dir, *needed), **options))

    return run


PEOPLE = ("respondents", "minutes")
INCOME = (*PEOPLE, "roster")
STATES = (*PEOPLE, "case_states", "state_names")
REPLICATES = (*PEOPLE, "replicate_weights")
DIARY = ("spells", "diary_days")


def _by_activity(s):
    return weighted_minutes(s.respondents, s.minutes)


def _by_group(s):
    return weighted_minutes(s.respondents, s.minutes, ["sex", "year"])


def _all_collapsed(s):
    return weighted_minutes(s.respondents, s.minutes, ["sex"], simplify=True)


def _by_category(s):
    return weighted_minutes(s.respondents, s.minutes, ["sex", "age"], simplify=categorize.CURATED)


def _by_mapping(s):
    """A mapping table as a user would pass it: the catalogue of tier-1 names."""
    tier1 = lookups.tier1_names(s.minutes.sparkSession).withColumnRenamed("code", "tier1")
    codes = s.minutes.select("activity").distinct().withColumn("tier1", F.substring("activity", 2, 2))
    mapping = codes.join(F.broadcast(tier1), "tier1", "left").select("activity", "description")
    return per_participant(s.respondents, s.minutes, ["sex"], simplify=mapping)


def _participation_by_activity(s):
    return participation(s.respondents, s.minutes)


def _participation_by_category(s):
    return participation(s.respondents, s.minutes, ["sex"], simplify=categorize.CURATED)


def _per_participant_by_sex(s):
    out = per_participant(s.respondents, s.minutes, ["sex"], simplify=categorize.CURATED)
    return out.withColumn("sex", labels.sex_label(F.col("sex")))


def _wide_form(s) -> reshape.WideTable:
    """One row per respondent with the minutes of every code in one array, as a wide file is read."""
    part = lambda at: F.substring("activity", at, 2).cast("int")
    # the place of a code in WIDE_CODES
    place = (F.when(part(2) == 18, 15).otherwise(part(2) - 1) * 9 + part(4) - 1) * 7 + part(6) - 1
    per_code = s.minutes.groupBy("case_id", "activity").agg(F.sum("minutes").alias("minutes"))
    spent = per_code.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "minutes"))).alias("spent"))
    people = s.respondents.select("case_id", "weight", "sex", "year").join(spent, "case_id", "left")

    def idle(size, end):
        return F.array_repeat(F.lit(0.0), end - size)

    spent_cells = F.coalesce("spent", F.array().cast(spent.schema["spent"].dataType))
    # the length of the row before each cell and after the last one
    sizes = F.aggregate(
        spent_cells,
        F.array(F.lit(0)),
        lambda known, x: F.concat(known, F.array(F.greatest(F.element_at(known, -1), x["place"]) + 1)),
    )
    end = F.lit(len(WIDE_CODES))
    # a row is put together once: copied per cell it would cost its length each time
    pieces = F.zip_with(
        spent_cells,
        sizes,
        lambda x, size: F.when(x.isNull(), F.array(idle(size, end))).otherwise(
            F.array(idle(size, x["place"]), F.array(x["minutes"]))
        ),
    )
    cells = F.flatten(F.flatten(pieces))
    return reshape.WideTable(people.select("case_id", "weight", "sex", "year", cells.alias("cells")), WIDE_CODES)


def _wide_unpivot(s):
    return reshape.unpivot_activities(_wide_form(s), ["case_id"])


def _wide_file(s) -> reshape.WideTable:
    wide = _wide_form(s)
    return replace(wide, data=wide.data.withColumnsRenamed({"case_id": "TUCASEID", "weight": "TUFNWGTP"}))


def _wide_estimates(s):
    return api.get_min_per_part(_wide_file(s), ["sex", "year"])


def _wide_minutes(s):
    wide = _wide_file(s)
    return api.get_minutes(wide, ["sex"], simplify=api.descriptions(wide))


def _wide_participation(s):
    wide = _wide_file(s)
    return api.get_participation(wide, ["year"], simplify=api.descriptions(wide))


def _wide_standard_errors(s):
    numbers = range(tables.REPLICATES)
    weights = s.replicate_weights.select(
        F.col("case_id").alias("TUCASEID"), *[F.col("weights")[i].alias(f"TUFNWGTP{i + 1:03d}") for i in numbers]
    )
    est = api.get_SE(_wide_file(s), weights, ["sex"], [c for c in WIDE_CODES if c.startswith("t12")])
    return variance.with_band(est)


def _diary_minutes(s):
    return diary.one_minute_spells(s.spells)


def _states_on_map(spark, sf_dir):
    s = tables.survey(spark, sf_dir, *STATES)
    out = reports.states_on_map(s, tables.map_names(spark, sf_dir))
    return rounded(out.select("name", "state_id", "total_leisure", "region_name", "distance"))


def _security(s):
    return reports.security_by_year(s, outlier=tables.OUTLIER_YEAR)


QUERIES: dict[str, Query] = {
    "weighted_minutes_by_activity": _report(_by_activity, *PEOPLE),
    "weighted_minutes_by_group": _report(_by_group, *PEOPLE),
    "weighted_minutes_all_collapsed": _report(_all_collapsed, *PEOPLE),
    "weighted_minutes_by_category": _report(_by_category, *PEOPLE),
    "weighted_minutes_by_mapping": _report(_by_mapping, *PEOPLE),
    "weighted_minutes_pivot_sex": _report(reports.hours_with_sexes_as_columns, *PEOPLE),
    "metrics_pivot_sex": _report(reports.summary_with_sexes_as_columns, *PEOPLE),
    "participation_by_activity": _report(_participation_by_activity, *PEOPLE),
    "participation_by_category": _report(_participation_by_category, *PEOPLE),
    "minutes_per_participant_by_sex": _report(_per_participant_by_sex, *PEOPLE),
    "summary_by_sex": _report(reports.summary_by_sex, *PEOPLE),
    "category_by_sex": _report(reports.category_by_sex, *PEOPLE),
    "wide_unpivot": _report(_wide_unpivot, *PEOPLE),
    "wide_estimates": _report(_wide_estimates, *PEOPLE),
    "wide_minutes": _report(_wide_minutes, *PEOPLE),
    "wide_participation": _report(_wide_participation, *PEOPLE),
    "wide_standard_errors": _report(_wide_standard_errors, *REPLICATES),
    "tv_by_age_sex": _report(reports.tv_by_age_sex, *PEOPLE),
    "trend_cubic": _report(reports.tv_cubic, *PEOPLE),
    "trend_loess": _report(reports.tv_by_age_wide, *PEOPLE),
    "trend_loess_by_group": _report(reports.work_trend, *PEOPLE),
    "household_trend": _report(reports.household_trend, *PEOPLE),
    "cooking_grocery_trend": _report(reports.cooking_grocery_trend, *PEOPLE),
    "job_search_trend": _report(reports.job_search_trend, *PEOPLE),
    "garden_trend": _report(reports.garden_trend, *PEOPLE),
    "cooking_trend": _report(reports.cooking_trend, *PEOPLE),
    "grocery_trend": _report(reports.grocery_trend, *PEOPLE),
    "trend_spline4": _report(reports.home_activities_spline, *PEOPLE),
    "category_spline": _report(reports.category_spline, *PEOPLE),
    "income_age_spline": _report(reports.income_age_spline, *INCOME),
    "sex_gap_wide": _report(reports.tv_sex_gap, *PEOPLE),
    "minutes_formatted": _report(reports.tv_formatted, *PEOPLE),
    "age_extent": _report(reports.age_extent, "respondents"),
    "replicate_se_by_age_sex": _report(reports.tv_standard_errors, *REPLICATES),
    "replicate_se_by_year": _report(reports.leisure_standard_errors, *REPLICATES),
    "metrics_by_sex_year_agebin": _report(reports.household_by_sex_year_agebin, *PEOPLE),
    "cooking_grocery_by_sex_year_agebin": _report(reports.cooking_grocery_by_sex_year_agebin, *PEOPLE),
    "metrics_long_by_year": _report(reports.work_by_year, *PEOPLE),
    "job_search_by_year": _report(reports.job_search_by_year, *PEOPLE),
    "garden_by_year_age_range": _report(reports.garden_by_year, *PEOPLE),
    "security_per_participant_by_year": _report(_security, *PEOPLE),
    "cooking_by_sex_age": _report(reports.cooking_by_sex_age, *PEOPLE),
    "grocery_by_sex_age": _report(reports.grocery_by_sex_age, *PEOPLE),
    "category_by_age_workday": _report(reports.category_by_age_workday, *PEOPLE),
    "home_activities_by_age_workday": _report(reports.home_activities_by_age_workday, *PEOPLE),
    "sports_share_by_income": _report(reports.sports_share_by_income, *INCOME),
    "waiting_share_by_income": _report(reports.waiting_share_by_income, *INCOME),
    "waiting_share_participants": _report(reports.waiting_share_participants, *INCOME),
    "category_by_income": _report(reports.category_by_income, *INCOME),
    "category_by_incomebin_age": _report(reports.category_by_incomebin_age, *INCOME),
    "leisure_by_state": _report(reports.leisure_by_state, *STATES),
    "leisure_by_state_region": _report(reports.leisure_by_state_region, *STATES),
    "state_fuzzy_match": _states_on_map,
    "computer_use_by_age_year": _report(reports.computer_use_by_age_year, *PEOPLE),
    "computer_use_loess": _report(reports.computer_use_loess, *PEOPLE),
    "rolling_mean_age": _report(reports.computer_use_rolling, *PEOPLE),
    "code_catalogue": _report(reports.code_catalogue, *PEOPLE),
    "weekend_minutes_long": _report(reports.weekend_minutes_long, *PEOPLE),
    "diary_minutes_normalised": _report(_diary_minutes, "spells"),
    "diary_slots_5min": _report(reports.weekday_slots, *DIARY),
    "diary_slots_5min_complete": _report(reports.weekday_slots_complete, *DIARY),
    "diary_sequence_5min": _report(reports.weekday_sequence, *DIARY),
    "diary_whole_day_ids": _report(reports.whole_day_cases, "spells"),
    "diary_sequence_1min": _report(reports.whole_day_sequence, "spells"),
    "demographics_weekend": _report(reports.demographics_weekend, "respondents", "roster"),
    "demographics_weekday": _report(reports.demographics_weekday, "respondents", "roster", *DIARY),
    "demographics_full": _report(reports.demographics_full, "respondents", "roster", *DIARY),
    "column_profile": _report(reports.demographics_profile, "respondents", "roster"),
}
