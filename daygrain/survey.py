"""The tables of one survey in canonical form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain import lookups
from daygrain.operators.breakdowns import one_per_case
from daygrain.operators.categorize import CURATED_V2, Labelling, unique_mapping
from daygrain.operators.reshape import WideTable, columns_matching, gathered, unpivot_cells
from daygrain.sources.readers import weight_column, without_missing


RESPONDENT_COLUMNS = {
    "TESEX": "sex",
    "TEAGE": "age",
    "TUYEAR": "year",
    "TRYHHCHILD": "age_youngest",
    "TRCHILDNUM": "n_child",
    "TUDIARYDAY": "diary_day",
    "TRHOLIDAY": "holiday",
}


@dataclass
class Survey:
    """Canonical frames; any of them may stay ``None`` if no report needs it.

    respondents        case_id, weight, sex, age, year, age_youngest, n_child, diary_day, holiday
    minutes            case_id, activity, minutes (positive only)
    roster             case_id, line, marital, race_code, educ_code, state_fips,
                       income_code, income_code_alt
    replicate_weights  case_id, weights (array of ``replicates`` numbers)
    spells             case_id, ordinal, start_clock, stop_clock, description
    diary_days         case_id, diary_day, holiday and further respondent columns
    case_states        case_id, state_id
    state_names        state_id, name, region
    activity_names     code, description: the survey's complete code list
    codes              activity: all codes of the survey, also those nobody spent time on
    """

    respondents: DataFrame | None = None
    minutes: DataFrame | None = None
    roster: DataFrame | None = None
    replicate_weights: DataFrame | None = None
    spells: DataFrame | None = None
    diary_days: DataFrame | None = None
    case_states: DataFrame | None = None
    state_names: DataFrame | None = None
    activity_names: DataFrame | None = None
    codes: DataFrame | None = None
    replicates: int | None = None
    work_day_minutes: float = 120
    diary_labels: tuple[str, ...] | Column | None = None
    diary_columns: tuple[str, ...] = ()
    unique_minutes: bool = False

    @property
    def work_day(self) -> tuple[str, float]:
        return ("t05", self.work_day_minutes)

    def names(self) -> DataFrame:
        """The complete code list, one row per six-digit code."""
        if self.activity_names is None:
            raise ValueError("this report needs the survey's code list: pass activity_names")
        listed = self.activity_names.select(F.concat(F.lit("t"), F.col("code")).alias("activity"), "description")
        return unique_mapping(listed).select(F.substring("activity", 2, 6).alias("code"), "description")

    def incomes(self) -> DataFrame:
        """One income code per case."""
        return one_per_case(self.roster, ["income_code"])

    @classmethod
    def from_tables(
        cls,
        summary: DataFrame | WideTable,
        activity: DataFrame | None = None,
        respondent: DataFrame | None = None,
        household: DataFrame | None = None,
        replicate_weights: DataFrame | None = None,
        activity_names: DataFrame | None = None,
        categories: Labelling = CURATED_V2,
    ) -> "Survey":
        """Build the canonical frames from the survey's published files."""
        if not isinstance(summary, WideTable):
            codes = tuple(columns_matching(summary))
            rest = [c for c in summary.columns if c not in codes]
            summary = WideTable(summary.select(*rest, gathered(codes).alias("cells")), codes)
        wide, summary = summary, summary.data
        spark = summary.sparkSession
        weight = weight_column(summary)
        summary = without_missing(summary, [weight])
        out = cls(unique_minutes=True)
        # a report that needs a column which is not there fails by its name
        out.respondents = summary.select(
            F.col("TUCASEID").alias("case_id"),
            F.col(weight).alias("weight"),
            *[F.col(c).alias(name) for c, name in RESPONDENT_COLUMNS.items() if c in summary.columns],
        )
        out.codes = spark.createDataFrame([(c,) for c in wide.codes], "activity string")
        cases = summary.select(F.col("TUCASEID").alias("case_id"), wide.cells)
        out.minutes = unpivot_cells(cases, ["case_id"], F.col(wide.cells), wide.codes, check=True)
        if activity_names is not None:
            out.activity_names = activity_names.select(
                F.col("Code").alias("code"), F.col("Description").alias("description")
            )
        if household is not None:
            out.roster = household.select(
                F.col("TUCASEID").alias("case_id"),
                F.col("TULINENO").alias("line"),
                F.col("PEMARITL").alias("marital"),
                F.col("PTDTRACE").alias("race_code"),
                F.col("PEEDUCA").alias("educ_code"),
                F.col("GESTFIPS").alias("state_fips"),
                F.col("HEFAMINC").alias("income_code"),
                F.col("HUFAMINC").alias("income_code_alt"),
            )
            states = one_per_case(out.roster, ["state_fips"])
            out.case_states = states.withColumnRenamed("state_fips", "state_id")
            # the regions list names the federal district, the state numbers do not
            regions = lookups.state_regions(spark).select(F.col("state").alias("name"), "region")
            out.state_names = (
                lookups.states(spark)
                .select(F.col("fips").alias("state_id"), "name")
                .join(F.broadcast(regions), "name", "left")
            )
        if replicate_weights is not None:
            replicates = [c for c in replicate_weights.columns if c != "TUCASEID"]
            out.replicates = len(replicates)
            out.replicate_weights = replicate_weights.select(
                F.col("TUCASEID").alias("case_id"),
                F.array(*[F.col(c).cast("double") for c in replicates]).alias("weights"),
            )
        if respondent is not None:
            out.diary_columns = ("day_of_week", "holiday", "year", "TRTALONE", "TRTALONE_WK", "TESCHFT")
            out.diary_days = respondent.select(
                F.col("TUCASEID").alias("case_id"),
                F.col("TUDIARYDAY").alias("diary_day"),
                F.col("TUDIARYDAY").alias("day_of_week"),
                F.col("TRHOLIDAY").alias("holiday"),
                F.col("TUYEAR").alias("year"),
                "TRTALONE",
                "TRTALONE_WK",
                "TESCHFT",
            )
        if activity is not None:
            coded = activity.select(
                F.col("TUCASEID").alias("case_id"),
                F.col("TUACTIVITY_N").cast("long").alias("ordinal"),
                F.col("TUSTARTTIM").alias("start_clock"),
                F.col("TUSTOPTIME").alias("stop_clock"),
                F.concat(F.lit("t"), F.col("TRCODEP")).alias("activity"),
            )
            out.spells = coded.withColumn("description", categories.description(F.col("activity")))
            out.diary_labels = tuple(x for x in categories.labels if x is not None)
        return out
