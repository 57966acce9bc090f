"""Demographic tables of the respondents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain import lookups
from daygrain.functions import labels
from daygrain.functions.numeric import larger_known
from daygrain.operators.breakdowns import one_per_case


def respondent_line(roster: DataFrame) -> DataFrame:
    """Marital status, race, education and state of the person who answered."""
    spark = roster.sparkSession
    names = lookups.states(spark).select(F.col("fips"), F.col("name").alias("state"))
    return (
        roster.filter(F.col("line") == 1)
        .select("case_id", "marital", "race_code", "educ_code", "state_fips")
        .join(F.broadcast(names), F.col("state_fips") == F.col("fips"), "left")
        .select(
            "case_id",
            labels.married(F.col("marital")).alias("married"),
            labels.race(F.col("race_code")).alias("race"),
            labels.education(F.col("educ_code")).alias("education"),
            "state",
        )
    )


def family_income(roster: DataFrame) -> DataFrame:
    """Household income per case: the larger of the two bracket floors that are known."""
    spark = roster.sparkSession
    floors = lookups.income_floors(spark)
    other = floors.withColumnsRenamed({"income_code": "other_code", "hh_income": "other_income"})
    codes = one_per_case(roster, ["income_code", "income_code_alt"])
    return (
        codes.join(F.broadcast(floors), "income_code", "left")
        .join(F.broadcast(other), F.col("income_code_alt") == F.col("other_code"), "left")
        .select("case_id", larger_known(F.col("hh_income"), F.col("other_income")).alias("hh_income"))
    )


def demographics(
    respondents: DataFrame,
    roster: DataFrame,
    population: DataFrame,
    diary_days: DataFrame | None = None,
    diary_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per case of ``population``.

    ``diary_days`` adds columns of the respondent file. All inputs are keyed by case id, so
    after the semi join the remaining joins reuse its partitioning.
    """
    youngest = labels.missing_if(F.col("age_youngest"), -1)
    base = (
        respondents.join(population.select("case_id").distinct(), "case_id", "left_semi")
        .select(
            "case_id",
            F.col("weight").alias("survey_weight"),
            "age",
            "sex",
            youngest.alias("age_youngest"),
            "n_child",
        )
    )
    out = base.join(family_income(roster), "case_id", "left").join(
        respondent_line(roster), "case_id", "left"
    )
    if diary_days is not None:
        out = out.join(diary_days.select("case_id", *diary_columns), "case_id", "left")
    under_12 = F.coalesce((F.col("age_youngest") < 12).cast("int"), F.lit(0))
    return out.withColumn("child_under_12", under_12)
