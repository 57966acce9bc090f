"""Replicate-weight standard errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.functions.numeric import ratio
from daygrain.operators.estimates import COLLAPSED_LABEL, _restrict

# fixed value: the survey's replicate variance factor is 4 / number of replicates
VARIANCE_FACTOR = 4.0


def person_minutes(minutes: DataFrame, activities=None) -> DataFrame:
    """Total minutes per case over the chosen activities."""
    return _restrict(minutes, activities).groupBy("case_id").agg(F.sum("minutes").alias("minutes"))


def replicate_se(
    people: DataFrame, replicate_weights: DataFrame, groups: Sequence[str], replicates: int | None = None
) -> DataFrame:
    """Standard error of the weighted mean of ``minutes`` per group.

    ``people`` holds ``case_id, weight, minutes`` and the groups, ``replicate_weights``
    ``case_id, weights`` with the replicates as an array. A respondent without replicate
    weights is an error, as the base estimate would change without them, and so is one with
    another number of them than ``replicates``, by default that of the first row.

    Replicates meet their respondent by case id and a person stays one row: every replicate has two plain sums, combined
    before the shuffle, which has one row per group and task. A missing weight in an array is an error.
    """
    if replicates is None:
        first = replicate_weights.select(F.size("weights").alias("n")).first()
        replicates = first["n"] if first else 0
    joined = _matched(people, replicate_weights.select("case_id", "weights"))
    found = F.coalesce(F.size("weights"), F.lit(0))
    other = _error(F.concat(found.cast("string"), F.lit(" replicate weights for case "), _case()))
    unfit = F.when(F.col("weights").isNull(), _none()).when(found != replicates, other)
    return _estimates(joined, list(groups), unfit, [F.get("weights", F.lit(i)) for i in range(replicates)])


def replicate_se_of_columns(people: DataFrame, replicate_weights: DataFrame, groups: Sequence[str]) -> DataFrame:
    """As ``replicate_se``, from one column per replicate beside ``case_id``, which are never packed into an array."""
    names = [c for c in replicate_weights.columns if c != "case_id"]
    own = {c: f"_replicate{i}" for i, c in enumerate(names)}  # a group may have the name of a replicate
    weights = replicate_weights.select("case_id", F.lit(True).alias("_found"), *[F.col(c).alias(own[c]) for c in names])
    unfit = F.when(F.col("_found").isNull(), _none())
    return _estimates(_matched(people, weights), list(groups), unfit, [F.col(own[c]) for c in names])


def _matched(people: DataFrame, weights: DataFrame) -> DataFrame:
    # a row of weights per respondent is far too much to broadcast or to sort: the narrow people are hashed and they pass by
    return people.hint("shuffle_hash").join(weights, "case_id", "left")


def _case() -> Column:
    return F.col("case_id").cast("string")


def _error(message: Column) -> Column:
    return F.raise_error(message).cast("double")


def _none() -> Column:
    return _error(F.concat(F.lit("no replicate weights for case "), _case()))


def _estimates(joined: DataFrame, groups: list[str], unfit: Column, series: Sequence[Column]) -> DataFrame:
    """Estimate and standard error per group from the base weight and the replicates; ``unfit`` has the errors of a row."""
    # one check for all weights of a person
    empty = F.greatest(F.lit(False), F.col("weight").isNull(), *[w.isNull() for w in series])
    missing = _error(F.concat(F.lit("NULL among the weights of case "), _case()))
    names = [f"_w{i}" for i in range(1 + len(series))]
    weights = [unfit.when(empty, missing).otherwise(F.col("weight")), *series]
    rows = joined.select(
        *groups,
        F.coalesce("minutes", F.lit(0.0)).alias("minutes"),
        *[w.cast("double").alias(name) for w, name in zip(weights, names)],
    )
    sums = rows.groupBy(*groups).agg(
        *[F.sum(name).alias(name) for name in names],
        *[F.sum(F.col(name) * F.col("minutes")).alias(f"{name}_minutes") for name in names],
    )
    # one row per group from here on
    theta = F.array(*[ratio(F.col(f"{name}_minutes"), F.col(name)) for name in names])
    estimates = sums.select(*groups, theta.alias("theta")).withColumn("weighted_minutes", F.get("theta", F.lit(0)))
    replicates = max(len(series), 1)
    apart = F.transform(F.slice("theta", 2, replicates), lambda x: F.pow(x - F.col("weighted_minutes"), 2))
    squares = F.array_compact(apart)
    total = F.when(F.size(squares) > 0, F.aggregate(squares, F.lit(0.0), lambda sum_, x: sum_ + x))
    return estimates.select(
        F.lit(COLLAPSED_LABEL).alias("activity"),
        *groups,
        "weighted_minutes",
        F.sqrt(F.lit(VARIANCE_FACTOR / replicates) * total).alias("se"),
    )


def standard_errors(
    respondents: DataFrame,
    minutes: DataFrame,
    replicate_weights: DataFrame,
    groups: Sequence[str],
    activities=None,
    replicates: int | None = None,
) -> DataFrame:
    """Weighted minutes over the chosen activities with their standard error."""
    totals = person_minutes(minutes, activities)
    people = (
        respondents.select("case_id", "weight", *groups)
        .join(totals, "case_id", "left")
        .withColumn("minutes", F.coalesce(F.col("minutes"), F.lit(0.0)))
    )
    return replicate_se(people, replicate_weights, groups, replicates)


def with_band(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """Lower and upper end of the band printed around an estimate."""
    reach = F.lit(factor) * F.col("se")
    return df.withColumn("lower", F.col("weighted_minutes") - reach).withColumn(
        "upper", F.col("weighted_minutes") + reach
    )
