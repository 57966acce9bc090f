"""The canonical survey frames derived from orders, line items and events.

Orders stand for respondents, line items for activity minutes and household members, user
events for diary spells, nations for states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrain import lookups
from daygrain.functions import clock
from daygrain.operators import diary
from daygrain.survey import Survey

SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# every code that the minutes can hold
CODES = tuple(
    f"{tier1:02d}{tier2:02d}{line:02d}" for tier1 in (*range(1, 16), 18) for tier2 in range(1, 10) for line in range(1, 8)
)


def _code_name(code: str) -> str:
    """A name for each code with the words that the reports look for, by its second pair of digits."""
    if code == "020905":
        return "Home security"
    summary = dict(lookups.TIER1_NAMES)[code[:2]]
    forms = (
        "Waiting associated with {}",
        "Waiting for/{}",
        "{} and leisure",
        "Security procedures related to {}",
        "{}, lawn and garden",
        "{}, n.e.c.*",
        "Waiting related to {}, n.e.c.*",
    )
    tier2 = int(code[2:4])
    form = forms[tier2 - 1] if tier2 <= len(forms) else "{}"
    return f"{form.format(summary)} ({code[4:]})"


CODE_NAMES = tuple((code, _code_name(code)) for code in CODES)

REPLICATES = 160
WORK_DAY_MINUTES = 30
OUTLIER_YEAR = 1999


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as case_id",
        "o_totalprice as weight",
        "cast(1 + o_orderkey % 2 as int) as sex",
        "cast(15 + o_custkey % 66 as int) as age",
        "cast(year(o_orderdate) as int) as year",
        "cast(case when o_custkey % 3 = 0 then -1 else o_orderkey % 18 end as int) as age_youngest",
        "cast(case when o_custkey % 3 = 0 then 0 else 1 + o_orderkey % 4 end as int) as n_child",
        "cast(1 + o_orderkey % 7 as int) as diary_day",
        "cast(case when o_orderkey % 50 = 0 then 1 else 0 end as int) as holiday",
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows may add to one (case, code); the operators sum them per case."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as case_id",
        """concat('t', substring(cast(1000000 + (case when l_partkey % 16 = 15 then 18 else 1 + l_partkey % 16 end) * 10000
             + (1 + l_suppkey % 9) * 100 + l_linenumber as string), 2, 6)) as activity""",
        "l_quantity as minutes",
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keeping line 1 becomes a limit per case that already applies before the shuffle
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("line", F.row_number().over(order))
        .selectExpr(
            "l_orderkey as case_id",
            "line",
            "cast(1 + l_partkey % 6 as int) as marital",
            "cast(1 + l_suppkey % 5 as int) as race_code",
            "cast(31 + l_partkey % 16 as int) as educ_code",
            "cast(1 + l_orderkey % 60 as int) as state_fips",
            "cast(case when l_orderkey % 17 = 16 then -1 else 1 + l_orderkey % 17 end as int) as income_code",
            "cast(case when l_orderkey % 19 > 15 then -1 else 1 + l_orderkey % 19 end as int) as income_code_alt",
        )
    )


def replicate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half or one and a half times the weight, by case and replicate."""
    # written out per replicate: generated code, where a function of the replicate would be interpreted
    odd = [f"(place * {r + 17} + {r * r}) % 1009 % 2 as odd{r}" for r in range(1, REPLICATES + 1)]
    # two products serve all replicates; naming a column more than once keeps the columns apart from the array, as one
    # method that makes the array from the place is too long to be compiled
    factor = "case odd{0} when 0 then half when 1 then more else o_totalprice * (0.5D + odd{0}) end"
    weights = ", ".join(factor.format(r) for r in range(1, REPLICATES + 1))
    # the file is one split: its rows are dealt out by case before they become arrays
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition("o_orderkey")
    placed = orders.selectExpr("o_orderkey as case_id", "o_totalprice", "cast(o_orderkey % 1009 as int) as place")
    columns = placed.selectExpr("case_id", "o_totalprice", "o_totalprice * 0.5D as half", "o_totalprice * 1.5D as more", *odd)
    return columns.selectExpr("case_id", f"array({weights}) as weights")


def _diary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = "ts - interval 4 hours"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id",
        f"cast({local} as date) as diary_date",
        f"hour({local}) * 60 + minute({local}) as start_min",
        "event_id",
        "event_type",
    )


def _clock_text(minute):
    at = (minute + clock.DAY_START) % clock.DAY
    two = lambda n: F.substring((n + 100).cast("string"), 2, 2)
    return F.concat(two(clock.whole(at, 60)), F.lit(":"), two(at % 60), F.lit(":00"))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event lasts until the next one of the same diary.

    Events of one minute share their start, so the next start is looked up among the at most
    1440 distinct minutes of a diary; a diary with very many events is never sorted whole.
    """
    events = _diary_events(spark, sf_dir).withColumn("start_clock", _clock_text(F.col("start_min")))
    diary = ["user_id", "diary_date"]
    minutes_used = events.groupBy(*diary, "start_min").agg(F.max("event_id").alias("last_event"))
    following = F.lead("start_min").over(Window.partitionBy(*diary).orderBy("start_min"))
    # one diary in ten stops before the end of the day
    day_end = F.when(
        F.col("user_id") % 10 == 0, F.greatest(F.col("start_min"), F.lit(clock.DAY - 1))
    ).otherwise(F.lit(clock.DAY))
    minutes_used = minutes_used.withColumn("next_clock", _clock_text(F.coalesce(following, day_end)))
    last = F.col("event_id") == F.col("last_event")
    return events.join(minutes_used, [*diary, "start_min"]).select(
        _case_id().alias("case_id"),
        F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("description"),
        "start_clock",
        F.when(last, F.col("next_clock")).otherwise(F.col("start_clock")).alias("stop_clock"),
    )


def _case_id():
    return F.col("user_id") * 100 + F.dayofmonth("diary_date")


def diary_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _diary_events(spark, sf_dir).select("user_id", "diary_date").distinct()
    return days.select(
        _case_id().alias("case_id"),
        F.dayofweek("diary_date").alias("diary_day"),
        F.dayofweek("diary_date").alias("day_of_week"),
        (F.col("diary_date") == F.lit("2024-01-01").cast("date")).cast("int").alias("holiday"),
        F.year("diary_date").alias("diary_year"),
    )


def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"), F.col("c_nationkey").alias("state_id")
    )


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("state_id"), F.col("n_name").alias("name"), F.col("r_name").alias("region")
    )


def map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as another source spells them: one letter short."""
    return table(spark, sf_dir, "nation").select(
        F.regexp_replace("n_name", "NATION", "NATIO").alias("region_name")
    )


BUILDERS = {
    "respondents": respondents,
    "minutes": minutes,
    "roster": roster,
    "replicate_weights": replicate_weights,
    "spells": spells,
    "diary_days": diary_days,
    "case_states": case_states,
    "state_names": state_names,
}


def survey(spark: SparkSession, sf_dir: str, *needed: str) -> Survey:
    """A survey with the named frames."""
    frames = {name: BUILDERS[name](spark, sf_dir) for name in needed}
    # the descriptions of the spells, read from the one column they come from
    labels = diary.described(table(spark, sf_dir, "events"), "event_type") if "spells" in needed else None
    return Survey(
        **frames,
        replicates=REPLICATES,
        diary_labels=labels,
        activity_names=spark.createDataFrame(list(CODE_NAMES), "code string, description string"),
        work_day_minutes=WORK_DAY_MINUTES,
        diary_columns=("day_of_week", "holiday", "diary_year"),
    )
