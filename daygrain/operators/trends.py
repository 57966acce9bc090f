"""Smooth trends per group: cubic and spline regression, local regression.

The input is a table of estimates with one point per group and x. Sums of products are
ordinary aggregates, so regressions never gather a group in one place; only its handful of
coefficients travels back to the points. Local regression ranks the points of a group, and
their distances to each of its few vertices, in windows: a task sorts one series of estimates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.session import cut_lineage

# relative size below which a column counts as a combination of the earlier ones
ALIAS_TOLERANCE = 1e-11

# fixed values of the published local regression method: share of the span's points that
# an interpolation cell may hold, widening of the data range, smallest cell to divide
CELL = 0.2
MARGIN = 0.005
SMALLEST_CELL = 0.05


def _keyed(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Group columns as one struct, which joins missing group values to each other."""
    return points.withColumn("_key", F.struct(F.lit(0).alias("_"), *groups))


def _solve(df: DataFrame, p: int, out: str, strict: bool = False) -> DataFrame:
    """Coefficients of p normal equations held in columns ``a_i_j`` (i <= j) and ``r_i``.

    A column that depends on earlier ones gets coefficient 0, or makes the whole result
    NULL when ``strict``.
    """
    kept = [c for c in df.columns if not c.startswith(("a_", "r_"))]
    work = df.withColumns({f"scale_{i}": F.col(f"a_{i}_{i}") for i in range(p)})
    for k in range(p):
        usable = F.col(f"a_{k}_{k}") > F.col(f"scale_{k}") * ALIAS_TOLERANCE
        work = work.withColumn(f"ok_{k}", usable)
        changed = {}
        for i in range(k + 1, p):
            factor = F.when(F.col(f"ok_{k}"), F.try_divide(f"a_{k}_{i}", f"a_{k}_{k}")).otherwise(0.0)
            for j in range(i, p):
                changed[f"a_{i}_{j}"] = F.col(f"a_{i}_{j}") - factor * F.col(f"a_{k}_{j}")
            changed[f"r_{i}"] = F.col(f"r_{i}") - factor * F.col(f"r_{k}")
        if changed:
            work = work.withColumns(changed)
    for k in reversed(range(p)):
        rest = F.col(f"r_{k}")
        for j in range(k + 1, p):
            rest = rest - F.col(f"a_{k}_{j}") * F.col(f"c_{j}")
        aliased = F.lit(None).cast("double") if strict else F.lit(0.0)
        value = F.when(F.col(f"ok_{k}"), F.try_divide(rest, F.col(f"a_{k}_{k}"))).otherwise(aliased)
        work = work.withColumn(f"c_{k}", value)
    return work.select(*kept, F.array(*[f"c_{k}" for k in range(p)]).alias(out))


def _normal_equations(df: DataFrame, keys: Sequence[str], basis: Sequence[str], y: str, weight: Column) -> DataFrame:
    p = len(basis)
    sums = []
    for i in range(p):
        for j in range(i, p):
            sums.append(F.sum(weight * F.col(basis[i]) * F.col(basis[j])).alias(f"a_{i}_{j}"))
        sums.append(F.sum(weight * F.col(basis[i]) * F.col(y)).alias(f"r_{i}"))
    return df.groupBy(*keys).agg(*sums)


# ---------------------------------------------------------------------------
# Cubic regression, with or without a knot at the median
# ---------------------------------------------------------------------------


def _polynomial_trend(points, groups, x, y, out, knot: bool) -> DataFrame:
    points = cut_lineage(points)
    fitted_from = _keyed(points, groups).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranges = fitted_from.groupBy("_key").agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.percentile(x, 0.5).alias("_mid")
    )

    def with_basis(df: DataFrame) -> DataFrame:
        # x on [-1, 1] keeps the powers comparable
        width = F.col("_hi") - F.col("_lo")
        scaled = lambda c: F.coalesce(F.try_divide(2.0 * (c - F.col("_lo")), width), F.lit(1.0)) - 1.0
        u = scaled(F.col(x))
        df = df.join(ranges, "_key").withColumn("_1", u).withColumn("_0", F.lit(1.0))
        df = df.withColumn("_2", F.col("_1") * F.col("_1")).withColumn("_3", F.col("_1") * F.col("_2"))
        if knot:
            beyond = F.greatest(F.col("_1") - scaled(F.col("_mid")), F.lit(0.0))
            df = df.withColumn("_b", beyond).withColumn("_4", F.col("_b") * F.col("_b") * F.col("_b"))
        return df

    basis = [f"_{i}" for i in range(5 if knot else 4)]
    equations = _normal_equations(with_basis(fitted_from), ["_key"], basis, y, F.lit(1.0))
    coefficients = _solve(equations, len(basis), "_c")
    fitted = sum((F.col("_c")[i] * F.col(b) for i, b in enumerate(basis)), F.lit(0.0))
    return (
        with_basis(_keyed(points, groups))
        .join(coefficients, "_key")
        .select(*[F.col(c) for c in points.columns], fitted.alias(out))
    )


def cubic_trend(points: DataFrame, groups: Sequence[str], x: str, y: str, out: str = "trend") -> DataFrame:
    """Least-squares cubic per group: the span of a cubic B-spline basis with 3 terms."""
    return _polynomial_trend(points, groups, x, y, out, knot=False)


def spline_trend(points: DataFrame, groups: Sequence[str], x: str, y: str, out: str = "trend") -> DataFrame:
    """Cubic regression spline per group with one knot at the median of x (4 terms)."""
    return _polynomial_trend(points, groups, x, y, out, knot=True)


# ---------------------------------------------------------------------------
# Local regression
# ---------------------------------------------------------------------------


def _division_ranks(n: Column, largest: Column, levels: int) -> Column:
    """Ranks that halve the points until no cell holds more than ``largest``.

    Only the number of points decides, so the ranks are plain arithmetic on ``n``.
    """
    cell = F.struct(F.lit(1).alias("l"), n.cast("int").alias("u"))
    cells = F.array(cell)
    ranks = F.array().cast("array<struct<m:int,l:int,u:int>>")
    for _ in range(levels):
        divisible = F.filter(cells, lambda c: c["u"] - c["l"] + 1 > largest)
        cuts = F.transform(
            divisible,
            lambda c: F.struct(
                F.floor((c["l"] + c["u"]) / 2).cast("int").alias("m"), c["l"].alias("l"), c["u"].alias("u")
            ),
        )
        ranks = F.concat(ranks, cuts)
        cells = F.flatten(
            F.transform(
                cuts,
                lambda c: F.array(
                    F.struct(c["l"].alias("l"), c["m"].alias("u")),
                    F.struct((c["m"] + 1).alias("l"), c["u"].alias("u")),
                ),
            )
        )
    return ranks


def _interpolation_vertices(series: DataFrame, span: float) -> DataFrame:
    """Per group the x values at which the local fit is computed.

    Their number depends on the span alone (9 for the default), never on the data.
    """
    levels = math.ceil(math.log2(1 / (span * CELL))) + 1
    n = F.col("n")
    largest = F.greatest(F.floor(n * F.lit(span * CELL)), F.lit(1)).cast("int")
    reach = F.greatest(
        F.col("hi") - F.col("lo"), F.greatest(F.abs("lo"), F.abs("hi")) * 1e-3 + 1e-30
    )
    shape = (
        series.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .withColumn("box_lo", F.col("lo") - MARGIN * reach)
        .withColumn("box_hi", F.col("hi") + MARGIN * reach)
        .withColumn("cuts", _division_ranks(n, largest, levels))
    )
    ranked = series.withColumn("r", F.row_number().over(Window.partitionBy("_key").orderBy("x")))
    wanted = shape.select("_key", F.explode("cuts.m").alias("r"))
    at_rank = (
        ranked.join(wanted, ["_key", "r"])
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("x_at"))
    )
    lower = lambda c: F.coalesce(F.try_element_at("x_at", c["l"] - 1), F.col("box_lo"))
    upper = lambda c: F.coalesce(F.try_element_at("x_at", c["u"]), F.col("box_hi"))
    wide = lambda c: upper(c) - lower(c) > SMALLEST_CELL * (F.col("box_hi") - F.col("box_lo"))
    inner = F.transform(
        F.filter("cuts", wide), lambda c: F.try_element_at("x_at", c["m"])
    )
    vertices = F.array_sort(
        F.concat(
            F.array("box_lo"), F.coalesce(inner, F.array().cast("array<double>")), F.array("box_hi")
        )
    )
    return shape.join(at_rank, "_key", "left").select("_key", "n", F.explode(vertices).alias("v"))


def _fits_at_vertices(series: DataFrame, vertices: DataFrame, span: float) -> DataFrame:
    """Value and slope of the locally weighted quadratic at every vertex."""
    at_vertex = Window.partitionBy("_key", "v")
    near = F.floor(F.col("n") * span + 1e-5)
    weighted = (
        series.join(vertices, "_key")
        .withColumn("d", F.abs(F.col("x") - F.col("v")))
        .withColumn("place", F.row_number().over(at_vertex.orderBy("d")))
        .withColumn("h", F.max(F.when(F.col("place") <= near, F.col("d"))).over(at_vertex))
        .filter(F.col("d") < F.col("h"))
        .withColumn("w", F.pow(1.0 - F.pow(F.col("d") / F.col("h"), 3), 3))
        .withColumn("_0", F.lit(1.0))
        .withColumn("_1", (F.col("x") - F.col("v")) / F.col("h"))
        .withColumn("_2", F.col("_1") * F.col("_1"))
    )
    equations = _normal_equations(weighted, ["_key", "v", "h"], ["_0", "_1", "_2"], "y", F.col("w"))
    return _solve(equations, 3, "c", strict=True).select(
        "_key", "v", F.col("c")[0].alias("value"), (F.col("c")[1] / F.col("h")).alias("slope")
    )


def _blend(x: Column, left: Column, right: Column) -> Column:
    """Cubic through two vertices that matches value and slope at both."""
    width = right["v"] - left["v"]
    t = (x - left["v"]) / width
    s = 1.0 - t
    return (
        s * s * (1.0 + 2.0 * t) * left["value"]
        + t * t * (3.0 - 2.0 * t) * right["value"]
        + t * s * s * width * left["slope"]
        - t * t * s * width * right["slope"]
    )


def loess_trend(
    points: DataFrame,
    groups: Sequence[str],
    x: str,
    y: str,
    out: str = "trend",
    span: float = 0.75,
) -> DataFrame:
    """Local quadratic regression per group, evaluated at the data points.

    The published method fits at a few vertices and interpolates between them. A point thus
    meets a constant number of vertices, never the other points of its group. Points with a
    missing y keep a NULL trend. Needs one point per group and x, and a ``span`` below 1.
    """
    if not 0 < span < 1:
        raise ValueError("span must lie between 0 and 1")
    points = cut_lineage(points)
    keyed = _keyed(points, groups)
    known = keyed.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    once = F.raise_error(F.lit("local regression needs one point per group and x")).cast("double")
    series = known.groupBy("_key", F.col(x).cast("double").alias("x")).agg(
        F.when(F.count(F.lit(1)) == 1, F.max(F.col(y).cast("double"))).otherwise(once).alias("y")
    )
    fits = _fits_at_vertices(series, _interpolation_vertices(series, span), span)
    curve = fits.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("v", "value", "slope"))).alias("_curve")
    )
    at = F.col(x).cast("double")
    left = F.element_at(F.filter("_curve", lambda e: e["v"] <= at), -1)
    right = F.element_at(F.filter("_curve", lambda e: e["v"] > at), 1)
    inside = F.col(y).isNotNull() & F.exists(F.coalesce("_curve", F.array().cast("array<struct<v:double,value:double,slope:double>>")), lambda e: e["v"] > at)
    trend = F.when(inside, _blend(at, left, right))
    return keyed.join(curve, "_key", "left").select(*[F.col(c) for c in points.columns], trend.alias(out))
