"""The survey-shaped tables on rows with odd keys."""

import pytest
from pyspark.sql import functions as F

from daygrain.testbed import queries, tables


@pytest.fixture
def folder(spark, tmp_path):
    orders = [(k, 7, p, "1995-01-01 00:00:00") for k in (0, 1, 5, 1008, 1009, 123456, -3, None) for p in (10.5, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, d string").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", "cast(d as timestamp_ntz) as o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    # case 1 has a code twice, case 5 none, case 1009 a line without a code
    lines = [(0, 0, 0, 1, 3.0), (1, 15, 8, 7, 4.0), (1, 15, 8, 7, 5.0), (1, 3, 2, 2, 6.0), (1009, None, 1, 1, 2.0), (-3, 1, 1, 1, None)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_replicate_weights_by_their_formula(spark, folder):
    factor = "transform(sequence(1, 160), r -> o_totalprice * (0.5D + (place * (r + 17) + r * r) % 1009 % 2))"
    placed = spark.read.parquet(f"{folder}/orders.parquet").selectExpr("*", "cast(o_orderkey % 1009 as int) as place")
    want = placed.selectExpr("o_orderkey as case_id", f"{factor} as weights")
    got = tables.replicate_weights(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.schema["weights"].dataType.elementType.simpleString() == "double"


def test_wide_rows_by_hand(spark, folder):
    wide = queries._wide_form(tables.survey(spark, folder, *queries.PEOPLE))
    rows = {r.case_id: r.cells for r in wide.data.filter("weight is not null").collect()}
    place = {code: i for i, code in enumerate(wide.codes)}

    def cells(**spent):
        return [spent.get(code, 0.0) for code in wide.codes]

    assert len(place) == 1008
    assert rows[0] == cells(t010101=3.0)
    assert rows[1] == cells(t180907=9.0, t040302=6.0)
    assert rows[5] == cells() and rows[None] == cells()
    assert rows[1009] is None
    assert rows[-3] == cells(t020201=None)
