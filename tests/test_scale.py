"""Plans a large table would get, and results when one key holds a third of all rows."""

import re

import pytest

from daygrain.testbed.oracle import ORACLE
from daygrain.testbed.queries import QUERIES
from tests.oracle_check import TABLES, compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large_plans(spark):
    """Physical plans without any automatic broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = {n: q(spark, SF)._jdf.queryExecution().executedPlan().toString() for n, q in QUERIES.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return plans


def test_no_cross_joins_and_no_python(large_plans):
    for name, plan in large_plans.items():
        assert "CartesianProduct" not in plan, name
        assert "Python" not in plan and "InPandas" not in plan, name
        assert "NestedLoopJoin" not in plan, name


def test_windows_are_partitioned(large_plans):
    for name, plan in large_plans.items():
        for window in re.findall(r"Window \[.*", plan):
            assert "windowspecdefinition(" in window
        # a single partition only ever receives partial aggregates
        for line, following in zip(plan.splitlines(), plan.splitlines()[1:]):
            if "Exchange SinglePartition" in line:
                assert "Aggregate" in following and "partial" in following, name


def test_facts_are_combined_before_the_shuffle(large_plans):
    plan = large_plans["minutes_per_participant_by_sex"]
    assert "partial_sum" in plan
    # one exchange of the fact, one of the respondents, the rest holds aggregated cells
    assert plan.count("FileScan") == 2
    for name in ("diary_sequence_5min", "diary_slots_5min"):
        assert "partial_min" in large_plans[name], name
        assert "SortAggregate" not in large_plans[name], name


def test_scans_read_only_what_is_needed(large_plans):
    plan = large_plans["tv_by_age_sex"]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("o_totalprice" in s and "o_orderdate" not in s for s in schemas)
    assert all("l_tax" not in s for s in schemas)


def test_respondent_line_is_limited_before_the_shuffle(large_plans):
    assert "WindowGroupLimit" in large_plans["demographics_weekend"]


def test_weighted_minutes_need_no_rows_brought_together(large_plans):
    plan = large_plans["weighted_minutes_by_group"]
    assert not re.search(r"hashpartitioning\(\w+#\d+L?, activity#\d+", plan)


def test_diaries_need_few_exchanges(large_plans):
    plan = large_plans["diary_sequence_1min"]
    # the cells, then everything of a case in one place
    by_case = re.findall(r"Exchange hashpartitioning\((case_id#\d+L[^)]*)\)", plan)
    assert len(by_case) == 2 and "k#" in by_case[1] and "k#" not in by_case[0]


def test_standard_errors_keep_one_row_per_person(large_plans):
    for name in ("replicate_se_by_age_sex", "replicate_se_by_year", "wide_standard_errors"):
        assert "Generate" not in large_plans[name], name


def test_standard_errors_are_plain_sums(large_plans):
    for name in ("replicate_se_by_age_sex", "replicate_se_by_year", "wide_standard_errors"):
        assert "UDF" not in large_plans[name] and "partial_sum" in large_plans[name], name


def test_wide_rows_are_put_together_once_per_person(large_plans):
    plan = large_plans["wide_standard_errors"]
    assert any("AS cells#" in line for line in plan.splitlines())
    # a function called per code has the finished row, not the expression that makes it from the person's minutes
    assert not re.search(r"transform\(\[\d[\d,]*\], lambdafunction\([^\n]*spent#", plan)


def test_days_are_selected_before_spells_expand(large_plans):
    for name in ("diary_sequence_5min", "diary_slots_5min"):
        plan = large_plans[name]
        # the plan is printed from its result down to its scans
        assert plan.index("Generate explode(sequence") < plan.index("getbit"), name
        assert "LeftSemi" in plan and plan.index("LeftSemi") < plan.index("Generate explode(sequence"), name


def test_labels_are_numbered_by_hash(large_plans):
    for name in ("diary_sequence_5min", "diary_slots_5min", "diary_sequence_1min"):
        assert "array_position" not in large_plans[name], name


def test_wide_plans_have_one_column_of_minutes(large_plans):
    for name in ("wide_unpivot", "wide_estimates", "wide_minutes", "wide_participation"):
        plan = large_plans[name]
        operators = [line for line in plan.splitlines() if "Project [" in line or "Generate " in line]
        assert operators and all(line.count("#") < 60 for line in operators), name


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duck(SF)
    extra = {
        "lineitem": "SELECT * REPLACE (CAST(7 AS BIGINT) AS l_orderkey, CAST(1 + range % 7 AS INT) AS l_linenumber)"
        " FROM lineitem, range(3000) WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) LIMIT 3000",
        "events": "SELECT * REPLACE (event_id + 1000000 + range * 1000 AS event_id, CAST(3 AS BIGINT) AS user_id)"
        " FROM (SELECT * FROM events ORDER BY event_id LIMIT 5), range(100)",
    }
    for name in TABLES:
        sql = f"SELECT * FROM {name}"
        if name in extra:
            columns = ", ".join(d[0] for d in con.execute(f"SELECT * FROM {name} LIMIT 0").description)
            sql += f" UNION ALL SELECT {columns} FROM ({extra[name]})"
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


HOT = (
    "minutes_per_participant_by_sex",
    "weighted_minutes_by_group",
    "category_by_age_workday",
    "replicate_se_by_year",
    "weekend_minutes_long",
    "waiting_share_by_income",
    "diary_minutes_normalised",
    "diary_slots_5min",
    "diary_sequence_5min",
    "diary_sequence_1min",
    "demographics_weekday",
    "demographics_full",
)


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_keep_results_whole(spark, skewed, name):
    con = duck(skewed)
    assert con.execute("SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)").fetchall()[0][0] > 0.3
    assert compare(spark, con, QUERIES[name], ORACLE[name], skewed) is None
