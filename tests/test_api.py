"""The functions on the wide summary file and the survey built from the published files."""

import re
import time

import pytest
from pyspark.sql import functions as F

import daygrain
from daygrain import api
from daygrain.operators import categorize, estimates, variance
from daygrain.operators.reshape import WideTable
from daygrain.plans import reports
from daygrain.sources import readers, writers

COLUMNS = "TUCASEID long, TUFNWGTP double, TESEX int, t010101 double, t050101 double, t050201 double, t120303 double"
ROWS = [
    (1, 100.0, 1, 400.0, 300.0, 0.0, 60.0),
    (2, 300.0, 1, 500.0, 0.0, 0.0, 0.0),
    (3, 200.0, 2, 450.0, 100.0, 30.0, 120.0),
]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_minutes_and_participation(wide):
    got = {(r.activity, r.TESEX): r for r in daygrain.get_min_per_part(wide, ["TESEX"]).collect()}
    assert len(got) == 8
    row = got["t050101", 1]
    assert (row.weighted_minutes, row.participation_rate, row.minutes_per_participant) == (75.0, 0.25, 300.0)
    assert got["t050201", 1].minutes_per_participant == 0


def test_one_group_as_text(wide):
    a = daygrain.get_participation(wide, "TESEX").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, daygrain.get_participation(wide, ["TESEX"]).collect()))


def test_collapsing_three_ways(spark, wide):
    pairs = api.descriptions(wide)
    mapping = spark.createDataFrame(pairs, "activity string, description string")
    a = sorted(map(tuple, daygrain.get_min_per_part(wide, ["TESEX"], simplify=pairs).collect()))
    b = sorted(map(tuple, daygrain.get_min_per_part(wide, ["TESEX"], simplify=mapping).collect()))
    assert a == b and len(a) == 6
    all_in_one = daygrain.get_minutes(wide, None, ["t050101", "t050201"], simplify=True).collect()
    assert [tuple(r) for r in all_in_one] == [("All activites provided", 56000.0 / 600)]


@pytest.mark.parametrize("n", [64, 65, 450])
def test_any_number_of_labels(spark, n):
    """Labels and column names of any kind and number take the same path."""
    names = [f"t{i}" for i in range(n)]
    df = spark.range(1, 4).selectExpr(
        "id as TUCASEID", "cast(id as double) as TUFNWGTP", *[f"cast((id + {i}) % 3 as double) as {c}" for i, c in enumerate(names)]
    )
    got = daygrain.get_min_per_part(df, None, names, [(c, f"label {c}") for c in names]).collect()
    assert len(got) == n
    for r in got:
        i = int(r.activity.removeprefix("label t"))
        spent = {k: (k + i) % 3 for k in (1, 2, 3)}
        assert r.weighted_minutes == pytest.approx(sum(k * m for k, m in spent.items()) / 6)
        assert r.participation_rate == pytest.approx(sum(k for k, m in spent.items() if m) / 6)
    with pytest.raises(ValueError):
        daygrain.get_minutes(df, None, names, [(names[0], "a"), *[(c, c) for c in names]])


def test_missing_minutes_in_the_wide_file(spark, wide):
    holed = wide.withColumn("t050201", F.when(F.col("TUCASEID") != 2, F.col("t050201")))
    for simplify in (None, True, api.descriptions(wide)):
        with pytest.raises(Exception, match="missing value in t050201"):
            daygrain.get_minutes(holed, ["TESEX"], simplify=simplify).collect()


def test_codes_nobody_spent_time_on(spark, wide):
    """The header decides which codes get a row, in the survey as in the functions."""
    idle = wide.withColumn("t120303", F.lit(0.0)).drop("TESEX")
    s = daygrain.Survey.from_tables(idle)
    got = estimates.weighted_minutes(s.respondents, s.minutes, codes=s.codes).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, daygrain.get_minutes(idle).collect()))
    assert {r.activity: r.weighted_minutes for r in got}["t120303"] == 0
    with pytest.raises(ValueError, match="code list"):
        reports.code_catalogue(s)
    s.activity_names = spark.createDataFrame([("010101", "Sleeping")], "code string, description string")
    assert reports.code_catalogue(s).count() == 4


def as_array(wide, name="cells"):
    codes = tuple(c for c in wide.columns if c.startswith("t"))
    rest = [c for c in wide.columns if c not in codes]
    return WideTable(wide.select(*rest, F.array(*codes).alias(name)), codes, name)


def test_one_array_gives_the_same_as_columns(spark, wide):
    array = as_array(wide, "spent")
    pairs = api.descriptions(wide)
    assert api.descriptions(array) == pairs
    mapping = spark.createDataFrame(pairs, "activity string, description string")
    for simplify in (None, True, pairs, mapping):
        for codes in (None, ["t120303", "t050101"]):
            if codes and isinstance(simplify, list):
                simplify = [p for p in pairs if p[0] in codes]
            got, want = (daygrain.get_min_per_part(x, ["TESEX"], codes, simplify) for x in (array, wide))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    weights = spark.createDataFrame([(i, 1.0 * i, 2.0) for i in (1, 2, 3)], "TUCASEID long, w1 double, w2 double")
    got, want = (daygrain.get_SE(x, weights, ["TESEX"], ["t050101", "t050201"]).collect() for x in (array, wide))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    status = [sorted((r.TUCASEID, r.work_status) for r in api.add_work_status(x).collect()) for x in (array, wide)]
    assert status[0] == status[1]
    a, b = (daygrain.Survey.from_tables(x).minutes.collect() for x in (array, wide))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    for bad in (lambda: daygrain.get_minutes(array, ["nope"]), lambda: daygrain.get_minutes(array, activities=["t999999"])):
        with pytest.raises(ValueError):
            bad()


def test_missing_minutes_in_an_array(wide):
    holed = as_array(wide.withColumn("t050201", F.when(F.col("TUCASEID") != 2, F.col("t050201"))))
    for simplify in (None, True, api.descriptions(wide)):
        with pytest.raises(Exception, match="missing value in t050201"):
            daygrain.get_minutes(holed, ["TESEX"], simplify=simplify).collect()


def test_a_row_is_computed_once_for_all_chosen_codes(spark):
    codes = tuple(f"t{i:06d}" for i in range(50))
    row = "flatten(array(array_repeat(1.0D * id, 20), array_repeat(2.0D, 30)))"
    data = spark.range(4).selectExpr("id as TUCASEID", f"if(id < 3, {row}, null) as cells")
    chosen = data.select(WideTable(data, codes).chosen(codes[15:25]).alias("minutes"))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and not re.search(r"lambdafunction\([^\n]*flatten\(", plan)
    assert [r.minutes for r in chosen.collect()] == [*([1.0 * i] * 5 + [2.0] * 5 for i in range(3)), [None] * 10]


def test_plans_of_a_wide_table_stay_small(spark):
    codes = tuple(f"t{i:06d}" for i in range(1000))
    data = spark.range(3).selectExpr("id as TUCASEID", "1.0D as TUFNWGTP", "array_repeat(1.0D, 1000) as cells")
    for simplify in (True, None, [(c, f"label {i % 38}") for i, c in enumerate(codes)]):
        start = time.perf_counter()
        df = daygrain.get_min_per_part(WideTable(data, codes), None, simplify=simplify)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert time.perf_counter() - start < 2.5
        assert plan.count("#") < 600 and len(plan) < 100_000


def test_deprecated_alias(wide):
    with pytest.warns(DeprecationWarning):
        old = daygrain.apply_weights(wide, ["TESEX"])
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, daygrain.get_minutes(wide, ["TESEX"]).collect()))


def test_single_year_weight(wide):
    single = wide.withColumnRenamed("TUFNWGTP", "TUFINLWGT")
    assert readers.weight_column(single) == "TUFINLWGT"
    assert daygrain.get_participation(single, ["TESEX"]).count() == 8


@pytest.mark.parametrize(
    "change",
    [
        lambda df: daygrain.get_minutes(df.drop("TUCASEID")),
        lambda df: daygrain.get_minutes(df.drop("TUFNWGTP")),
        lambda df: daygrain.get_minutes(df, ["nope"]),
        lambda df: daygrain.get_minutes(df, simplify=df),
        lambda df: daygrain.get_minutes(df, simplify=[("t010101", "a"), ("t010101", "b")]),
        lambda df: daygrain.get_minutes(df.select("TUCASEID", "TUFNWGTP")),
    ],
)
def test_bad_input(wide, change):
    with pytest.raises(ValueError):
        change(wide)


def test_standard_error_does_not_depend_on_order(spark, wide):
    weights = spark.createDataFrame([(3, 150.0, 250.0), (1, 150.0, 50.0), (2, 250.0, 350.0)], "TUCASEID long, w1 double, w2 double")
    got = {r.TESEX: r for r in daygrain.get_SE(wide, weights, ["TESEX"], ["t050101"]).collect()}
    base, first, second = 75.0, 300 * 150 / 400, 300 * 50 / 400
    assert got[1].weighted_minutes == pytest.approx(base)
    assert got[1].se == pytest.approx((4 / 2 * ((first - base) ** 2 + (second - base) ** 2)) ** 0.5)
    assert got[2].se == 0


def test_standard_errors_of_columns(spark, wide):
    rows = [(1, 1, 100.0, 10.0), (2, 1, 300.0, None), (3, 2, 50.0, 20.0)]
    people = spark.createDataFrame(rows, "case_id long, w1 int, weight double, minutes double")
    kept = [(1, 150.0, 50.0), (2, 150.0, 450.0), (3, 25.0, 75.0), (4, 1.0, 1.0)]
    weights = spark.createDataFrame(kept, "case_id long, w1 double, w2 double")
    # a group may be called as a replicate is
    got = sorted(map(tuple, variance.replicate_se_of_columns(people, weights, ["w1"]).collect()))
    array = weights.select("case_id", F.array("w1", "w2").alias("weights"))
    assert got == sorted(map(tuple, variance.replicate_se(people, array, ["w1"]).collect()))
    assert [r[1:3] for r in got] == [(1, 2.5), (2, 20.0)]
    assert got[0][3] == pytest.approx((4 / 2 * ((5.0 - 2.5) ** 2 + (1.0 - 2.5) ** 2)) ** 0.5) and got[1][3] == 0
    with pytest.raises(Exception, match="no replicate weights for case 3"):
        variance.replicate_se_of_columns(people, weights.filter("case_id <> 3"), []).collect()
    holed = weights.withColumn("w2", F.when(F.col("case_id") != 2, F.col("w2")))
    unweighted = people.withColumn("weight", F.when(F.col("case_id") != 2, F.col("weight")))
    for who, what in ((people, holed), (unweighted, weights)):
        with pytest.raises(Exception, match="NULL among the weights of case 2"):
            variance.replicate_se_of_columns(who, what, []).collect()


def test_number_of_replicates(spark, wide):
    weights = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 3.0])], "case_id long, weights array<double>")
    people = wide.selectExpr("TUCASEID as case_id", "TUFNWGTP as weight", "TESEX", "t050101 as minutes")
    with pytest.raises(Exception, match="1 replicate weights for case 2"):
        variance.replicate_se(people, weights, ["TESEX"], 2).collect()
    assert variance.replicate_se(people.limit(0), weights.limit(0), ["TESEX"]).count() == 0
    holed = spark.createDataFrame([(i, [1.0, None, 2.0]) for i in (1, 2, 3)], "case_id long, weights array<double>")
    with pytest.raises(Exception, match="NULL"):
        variance.replicate_se(people, holed, []).collect()
    whole = spark.createDataFrame([(i, [1.0, 0.0, 2.0]) for i in (1, 2, 3)], "case_id long, weights array<double>")
    row = variance.replicate_se(people, whole, []).first()
    base, other = 50000.0 / 600, 400.0 / 3
    # a replicate without any weight has no estimate
    assert row.weighted_minutes == pytest.approx(base)
    assert row.se == pytest.approx((4 / 3 * 2 * (other - base) ** 2) ** 0.5)
    idle = people.selectExpr("case_id", "weight", "TESEX", "0.0D as minutes")
    assert {(r.weighted_minutes, r.se) for r in variance.replicate_se(idle, whole, ["TESEX"]).collect()} == {(0.0, 0.0)}


def test_work_status(wide):
    assert [r.work_status for r in api.add_work_status(wide).orderBy("TUCASEID").collect()] == [True, False, True]


def test_wide_file_as_lines(spark, tmp_path):
    text = " TUCASEID , TUFNWGTP,TESEX,t010101,TUYEAR,t050101 ,t120303\n"
    rows = [" 20030100013280 ,8155462.67,1,870,2003, 0 ,30", "20030100013344,1735322.52,NA,620,,480,0", ""]
    for name, own in (("a", rows[:1]), ("b", rows[1:])):
        (tmp_path / f"{name}.dat").write_text(text + "\n".join(own) + "\n")
    wide = readers.read_wide_table(spark, str(tmp_path))
    assert wide.codes == ("t010101", "t050101", "t120303")
    assert wide.data.schema["cells"].dataType.simpleString() == "array<double>"
    got = {r.TUCASEID: r for r in wide.data.collect()}
    first, second = got[20030100013280], got[20030100013344]
    assert (first.TUFNWGTP, first.TESEX, first.TUYEAR, first.cells) == (8155462.67, 1, 2003, [870, 0, 30])
    assert (second.TESEX, second.TUYEAR, second.cells) == (None, None, [620, 480, 0])
    plain = readers.read_table(spark, str(tmp_path / "b.dat"))
    a = daygrain.get_minutes(readers.read_wide_table(spark, str(tmp_path / "b.dat")), "TESEX")
    assert sorted(map(str, a.collect())) == sorted(map(str, daygrain.get_minutes(plain, "TESEX").collect()))


@pytest.mark.parametrize("line", ["1,2.0,3.0,4.0", "1,2.0", '1,2.0,"3.0"', "1,x,3.0", "1,2.0,x"])
def test_bad_lines_of_a_wide_file(spark, tmp_path, line):
    (tmp_path / "w.dat").write_text(f"TUCASEID,TUFNWGTP,t010101\n{line}\n")
    with pytest.raises(Exception):
        daygrain.get_minutes(readers.read_wide_table(spark, str(tmp_path / "w.dat"))).collect()


def test_wide_file_needs_activities(spark, tmp_path):
    (tmp_path / "w.dat").write_text("TUCASEID,TUFNWGTP\n")
    with pytest.raises(ValueError):
        readers.read_wide_table(spark, str(tmp_path / "w.dat"))


# --- files ----------------------------------------------------------------


def survey_files(folder):
    files = {
        "sum.dat": "TUCASEID,TUFNWGTP,TEAGE,TESEX,TUYEAR,TRYHHCHILD,TRCHILDNUM,TUDIARYDAY,TRHOLIDAY,t010101,t050101,t120303\n"
        "20030100013280,8155462.67,60,1,2003,-1,0,2,0,870,0,30\n"
        "20030100013344,1735322.52,41,2,2003,0,2,7,0,620,480,0\n",
        "act.dat": "TUCASEID,TUACTIVITY_N,TUSTARTTIM,TUSTOPTIME,TRCODEP\n"
        "20030100013280,1,04:00:00,18:30:00,010101\n"
        "20030100013280,2,18:30:00,19:00:00,120303\n"
        "20030100013280,3,19:00:00,04:00:00,010101\n",
        "resp.dat": "TUCASEID,TUDIARYDAY,TRHOLIDAY,TUYEAR,TRTALONE,TRTALONE_WK,TESCHFT\n"
        "20030100013280,2,0,2003,100,0,-1\n"
        "20030100013344,7,0,2003,20,0,1\n",
        "cps.dat": "TUCASEID,TULINENO,PEMARITL,PTDTRACE,PEEDUCA,GESTFIPS,HEFAMINC,HUFAMINC\n"
        "20030100013280,1,1,2,44,13,8,-1\n"
        "20030100013280,2,1,1,40,13,8,-1\n"
        "20030100013344,1,6,1,39,11,-1,16\n",
        "wgts.dat": "TUCASEID,TUFNWGTP001,TUFNWGTP002\n20030100013344,1,2\n20030100013280,3,4\n",
        "notes.txt": "not a table",
    }
    for name, text in files.items():
        (folder / name).write_text(text)


def test_directory_to_reports(spark, tmp_path):
    survey_files(tmp_path)
    t = readers.read_directory(spark, str(tmp_path))
    assert sorted(t) == ["act", "cps", "resp", "sum", "wgts"]
    assert spark.table("sum").schema["t010101"].dataType.simpleString() == "double"
    assert t["act"].first().TRCODEP == "010101"
    names = spark.createDataFrame([("010101", "Sleeping"), ("120303", "Leisure at home"), ("120304", "Leisure away")], "Code string, Description string")
    s = daygrain.Survey.from_tables(t["sum"], t["act"], t["resp"], t["cps"], t["wgts"], activity_names=names)
    assert s.minutes.count() == 4
    day = {r.period: r.description for r in reports.weekday_sequence(s).collect()}
    assert len(day) == 48 and day[1] == "Sleep" and day[30] == "Socializing, Relaxing, and Leisure"
    assert [r.case_id for r in reports.whole_day_cases(s).collect()] == [20030100013280]
    full = reports.demographics_full(s).first()
    assert (full.state, full.education, full.race, full.hh_income) == ("Georgia", "Masters", "black", 25000.0)
    assert (full.TRTALONE, full.year, full.age_youngest, full.child_under_12) == (100, 2003, None, 0)
    weekend = reports.demographics_weekend(s).first()
    # the state numbers have no federal district
    assert (weekend.state, weekend.hh_income, weekend.child_under_12) == (None, 150000.0, 1)
    assert reports.leisure_standard_errors(s).count() == 1
    assert reports.tv_standard_errors(s).count() == 2
    summary = {(r.activity, r.sex): r.weighted_hours for r in reports.summary_by_sex(s).collect()}
    assert summary["Sleep", "Male"] == 14.5 and summary["Work", "Female"] == 8.0
    assert {r.name for r in reports.leisure_by_state(s).collect()} == {"Georgia"}
    long = reports.weekend_minutes_long(s)
    assert long.count() == 15 and long.agg(F.sum("minutes")).first()[0] == 1100


def test_code_tables_keep_leading_zeros(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text('"Code"+"Description"\n"010101"+"Sleeping "\n"020101"+"Interior cleaning"\n')
    rows = readers.read_code_table(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("010101", "Sleeping"), ("020101", "Interior cleaning")]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(15, 1.5, None, 1.0, 2.0)], "age int, Male double, Female double, Male_smooth double, Female_smooth double").coalesce(1)
    writers.write_csv(df, str(tmp_path / "a"))
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("*.csv"))
    assert text == "age,Male,Female,Male_smooth,Female_smooth\n15,1.5,NA,1.0,2.0\n"
    assert tuple(readers.read_trend_table(spark, str(tmp_path / "a")).first()) == (15, 1.5, None, 1.0, 2.0)
    writers.write_tsv(df, str(tmp_path / "b"))
    assert "15\t1.5\tNA" in "".join(p.read_text() for p in (tmp_path / "b").glob("*.csv"))
    writers.write_parquet(df, str(tmp_path / "c"), ["age"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_missing_minutes_are_an_error(spark):
    df = spark.createDataFrame([(1, None)], "a int, minutes double")
    with pytest.raises(Exception, match="missing value in minutes"):
        readers.without_missing(df, ["minutes"]).collect()


def test_unmatched_category_in_header():
    assert categorize.label_header(["t010101", "t990101"]) == [("t010101", "Sleep"), ("t990101", None)]
