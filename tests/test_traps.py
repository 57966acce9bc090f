"""Hand-made rows for the cases that are easy to get wrong."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from daygrain import lookups
from daygrain.functions import clock, labels, numeric
from daygrain.operators import breakdowns, categorize, demographics, diary, estimates, prefilter, profile, reshape, variance
from daygrain.operators.categorize import CURATED, Labelling
from tests.code_names import ACTIVITY_NAMES


def people(spark, rows):
    return spark.createDataFrame(rows, "case_id long, weight double, sex int")


def facts(spark, rows):
    return spark.createDataFrame(rows, "case_id long, activity string, minutes double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- estimates ------------------------------------------------------------


def test_person_counts_once_after_collapsing(spark):
    r = people(spark, [(1, 2.0, 1), (2, 6.0, 1)])
    m = facts(spark, [(1, "t020101", 10.0), (1, "t020102", 20.0)])
    for how in (True, CURATED):
        rows = estimates.per_participant(r, m, ["sex"], simplify=how).filter("weighted_minutes > 0")
        row = one(rows)
        assert row.participation_rate == pytest.approx(0.25)
        assert row.weighted_minutes == pytest.approx(7.5)
        assert row.minutes_per_participant == pytest.approx(30.0)


def test_nobody_takes_part(spark):
    r = people(spark, [(1, 2.0, 1)])
    m = facts(spark, [(2, "t020101", 10.0)])
    row = one(estimates.per_participant(r, m, ["sex"], simplify=True))
    assert (row.weighted_minutes, row.participation_rate, row.minutes_per_participant) == (0, 0, 0)


def test_zero_cells_and_null_groups(spark):
    r = people(spark, [(1, 1.0, 1), (2, 1.0, None)])
    m = facts(spark, [(1, "t020101", 10.0), (2, "t030101", 5.0)])
    got = {
        (x.activity, x.sex): x.weighted_minutes for x in estimates.weighted_minutes(r, m, ["sex"]).collect()
    }
    assert got == {("t020101", 1): 10, ("t020101", None): 0, ("t030101", 1): 0, ("t030101", None): 5}
    listed = estimates.weighted_minutes(r, m, ["sex"], activities=["t020101", "t990101"])
    assert {(x.activity, x.sex): x.weighted_minutes for x in listed.collect()} == {
        ("t020101", 1): 10, ("t020101", None): 0, ("t990101", 1): 0, ("t990101", None): 0,
    }


def test_no_groups(spark):
    r = people(spark, [(1, 1.0, 1), (2, 3.0, 2)])
    m = facts(spark, [(1, "t020101", 10.0), (1, "t020101", 2.0)])
    row = one(estimates.per_participant(r, m))
    assert (row.weighted_minutes, row.participation_rate, row.minutes_per_participant) == (3.0, 0.25, 12.0)


def test_unmapped_code_is_a_null_category(spark):
    r = people(spark, [(1, 1.0, 1), (2, 1.0, 2)])
    m = facts(spark, [(1, "t990101", 10.0), (2, "t020101", 4.0)])
    rows = estimates.weighted_minutes(r, m, ["sex"], simplify=CURATED).collect()
    assert {x.sex: x.weighted_minutes for x in rows if x.activity is None} == {1: 10.0, 2: 0.0}
    assert len(rows) == 2 * (15 + 1)
    known = estimates.weighted_minutes(r, m.filter("case_id = 2"), ["sex"], simplify=CURATED)
    assert known.filter("activity is null").count() == 0
    mapping = spark.createDataFrame([("t020101", "Home")], "activity string, description string")
    rows = estimates.weighted_minutes(r, m, ["sex"], simplify=mapping).collect()
    assert {(x.activity, x.sex): x.weighted_minutes for x in rows} == {
        ("Home", 1): 0, ("Home", 2): 4, (None, 1): 10, (None, 2): 0,
    }


def test_duplicate_mapping_row_is_an_error(spark):
    r, m = people(spark, [(1, 1.0, 1)]), facts(spark, [(1, "t020101", 1.0)])
    twice = spark.createDataFrame([("t020101", "A"), ("t020101", "B")], "activity string, description string")
    with pytest.raises(Exception, match="listed twice"):
        estimates.weighted_minutes(r, m, ["sex"], simplify=twice).collect()


def test_label_and_code_paths_agree(spark):
    rows = [(i, 1.0 + i, 1 + i % 2) for i in range(50)]
    spent = [(i % 50, f"t{1 + i % 16:02d}{1 + i % 7:02d}01", 1.0 + i % 13) for i in range(400)]
    r, m = people(spark, rows), facts(spark, spent)
    mapping = spark.createDataFrame(
        categorize.label_header(sorted({a for _, a, _ in spent})), "activity string, description string"
    )
    by_slot = {(x.activity, x.sex): x[2:] for x in estimates.per_participant(r, m, ["sex"], simplify=CURATED).collect()}
    by_code = {(x.activity, x.sex): x[2:] for x in estimates.per_participant(r, m, ["sex"], simplify=mapping).collect()}
    assert set(by_code) <= set(by_slot)
    for key, values in by_code.items():
        assert by_slot[key] == pytest.approx(values)


def test_work_day_flag(spark):
    r = people(spark, [(1, 1.0, 1), (2, 1.0, 1), (3, 1.0, 1)])
    m = facts(spark, [(1, "t050101", 70.0), (1, "t050201", 50.0), (2, "t050101", 119.0), (2, "t180501", 60.0)])
    got = estimates.weighted_minutes(r, m, ["work_day"], simplify=True, work_day=("t05", 120))
    assert {x.work_day: x.weighted_minutes for x in got.collect()} == {True: 120.0, False: 179.0 / 2}


# --- variance -------------------------------------------------------------


def test_standard_error_by_hand(spark):
    p = spark.createDataFrame([(1, 1.0, 10.0, 1), (2, 1.0, 20.0, 1)], "case_id long, weight double, minutes double, g int")
    w = spark.createDataFrame([(2, [1.0, 3.0]), (1, [3.0, 1.0])], "case_id long, weights array<double>")
    row = one(variance.with_band(variance.replicate_se(p, w, ["g"])))
    # estimates 12.5 and 17.5 around 15, factor 4 / 2
    assert row.weighted_minutes == 15.0
    assert row.se == pytest.approx((2 * (2.5**2 + 2.5**2)) ** 0.5)
    assert row.upper - row.lower == pytest.approx(4 * row.se)
    same = spark.createDataFrame([(1, [1.0] * 5), (2, [1.0] * 5)], "case_id long, weights array<double>")
    assert one(variance.replicate_se(p, same, ["g"])).se == 0


def test_missing_replicate_weights_are_an_error(spark):
    p = spark.createDataFrame([(1, 1.0, 10.0, 1), (2, 1.0, 30.0, 1)], "case_id long, weight double, minutes double, g int")
    w = spark.createDataFrame([(1, [3.0, 1.0])], "case_id long, weights array<double>")
    with pytest.raises(Exception, match="no replicate weights for case 2"):
        variance.replicate_se(p, w, ["g"]).collect()


# --- diaries --------------------------------------------------------------


def spells(spark, rows):
    return spark.createDataFrame(rows, "case_id long, ordinal long, start_min int, end_min int, description string")


def test_boundary_slot_belongs_to_the_first_spell(spark):
    s = spells(spark, [(1, 1, 600, 605, "A"), (1, 2, 605, 610, "B")])
    got = {x.minute: x.description for x in diary.five_minute_slots(s, ["A", "B"]).collect()}
    assert got == {600: "A", 605: "A", 610: "B"}


def test_half_open_minutes(spark):
    s = spells(spark, [(1, 1, 600, 605, "A"), (1, 2, 605, 606, "B"), (1, 3, 630, 630, "A")])
    assert [tuple(x) for x in diary.one_minute_sequence(s).collect()] == [(1, 21, "A")]


def test_four_am_wrap(spark):
    rows = [(1, 1, "23:50:00", "04:00:00"), (1, 2, "03:00:00", "05:00:00"), (1, 3, "04:03:59", "04:07:00")]
    raw = spark.createDataFrame(rows, "case_id long, ordinal long, start_clock string, stop_clock string")
    five = {x.ordinal: (x.start_min, x.end_min) for x in diary.five_minute_spells(raw).collect()}
    one_minute = {x.ordinal: (x.start_min, x.end_min) for x in diary.one_minute_spells(raw).collect()}
    assert five == {1: (1190, 1435), 2: (1380, 1435), 3: (0, 5)}
    assert one_minute == {1: (1190, 1440), 2: (1380, 1440), 3: (3, 7)}


@pytest.mark.parametrize("first,second", ["AB", "BA"])
def test_mode_tie_goes_to_the_earlier(spark, first, second):
    s = spells(spark, [(1, 1, 0, 15, first), (1, 2, 15, 30, second)])
    assert one(diary.one_minute_sequence(s)).description == first
    # slots 0, 5, 10, 15 belong to the first spell, 20 and 25 to the second
    s = spells(spark, [(1, 1, 0, 10, first), (1, 2, 15, 25, second)])
    assert one(diary.five_minute_sequence(s)).description == first


def test_missing_slots_give_no_row(spark):
    s = spells(spark, [(1, 1, 0, 29, "A"), (1, 2, 90, 119, "B")])
    assert sorted(x.period for x in diary.one_minute_sequence(s).collect()) == [1, 4]
    slots = diary.five_minute_slots(spells(spark, [(1, 1, 0, 5, "A")]))
    complete = diary.complete_slots(slots).collect()
    assert len(complete) == 288 and sum(x.description is not None for x in complete) == 2


def test_mode_ignores_missing_descriptions(spark):
    s = spells(spark, [(1, 1, 0, 20, None), (1, 2, 25, 25, "A"), (2, 1, 0, 25, None)])
    assert [tuple(x) for x in diary.five_minute_sequence(s, ["A"]).collect()] == [(1, 1, "A")]
    assert diary.five_minute_slots(s, ["A"]).count() == 12


def test_label_outside_the_list_is_an_error(spark):
    with pytest.raises(Exception, match="not in the label list"):
        diary.five_minute_slots(spells(spark, [(1, 1, 0, 5, "C")]), ["A"]).collect()


def test_sequence_against_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = []
    for case in range(20):
        at, ordinal = 0, 0
        while at < 1440:
            end = min(1440, at + rng.choice([1, 3, 7, 20, 45, 130]))
            rows.append((case, ordinal, at, end, rng.choice(["A", "B", "C", None])))
            at, ordinal = end + rng.choice([0, 0, 0, 11]), ordinal + 1
    got = {(x.case_id, x.period): x.description for x in diary.one_minute_sequence(spells(spark, rows)).collect()}
    want = {}
    for case in range(20):
        for period in range(48):
            seen = [
                d for c, _, a, b, d in rows if c == case for t in range(a, b) if t // 30 == period and d is not None
            ]
            if seen:
                want[case, period + 1] = max(dict.fromkeys(seen), key=seen.count)
    assert got == want
    five = [(c, o, a // 5 * 5, min(b // 5 * 5, 1435), d) for c, o, a, b, d in rows if a < 1436]
    got = {(x.case_id, x.period): x.description for x in diary.five_minute_sequence(spells(spark, five)).collect()}
    want = {}
    for case in range(20):
        slots = {}
        for c, o, a, b, d in five:
            if c == case:
                for t in range(a, b + 1, 5):
                    slots.setdefault(t, d)
        for period in range(48):
            seen = [slots[t] for t in sorted(slots) if t // 30 == period and slots[t] is not None]
            if seen:
                want[case, period + 1] = max(dict.fromkeys(seen), key=seen.count)
    assert got == want


def test_whole_days(spark):
    s = spells(spark, [(1, 1, 0, 1440, "A"), (2, 1, 0, 1439, "A")])
    assert [x.case_id for x in diary.whole_day_cases(s).collect()] == [1]
    rows = diary.one_minute_sequence(s).filter("case_id = 1").collect()
    assert {r.period: r.description for r in rows} == dict.fromkeys(range(1, 49), "A")


def test_whole_days_in_the_same_pass(spark):
    s = spells(spark, [(1, 1, 0, 100, "A"), (1, 2, 100, 1440, None), (2, 1, 0, 1439, "A"), (3, 1, 0, 1440, None)])
    got = diary.one_minute_sequence(s, whole_days=True)
    assert {(r.case_id, r.period) for r in got.collect()} == {(1, p) for p in (1, 2, 3, 4)}
    chosen = spark.createDataFrame([(2,)], "case_id long")
    assert {r.case_id for r in diary.one_minute_sequence(s, cases=chosen).collect()} == {2}


def test_select_days(spark):
    days = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 2, 1)], "case_id long, diary_day int, holiday int")
    assert [x.case_id for x in diary.select_days(days, diary.WEEKDAYS).collect()] == [2]
    assert [x.case_id for x in diary.select_days(days, diary.WEEKEND).collect()] == [1]


# --- recodes --------------------------------------------------------------


def values(spark, column, expression, schema="x int"):
    df = spark.createDataFrame([(v,) for v in column], schema)
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_education_race_married(spark):
    assert values(spark, [-1, 38, 39, 42, 43, 44, 45, 46, None], labels.education) == [
        "Did not graduate from HS", None, "HS", "Some college", "Bachelors", "Masters", "Doctoral", None, None,
    ]
    assert values(spark, [1, 2, 3, 4, None], labels.race) == ["white", "black", "other", "asian", "other"]
    assert values(spark, [1, 2, None], labels.married) == [1, 0, None]


def test_bins(spark):
    assert values(spark, [20, 40, 41, 60, 100, 101, None], lambda c: labels.bin_rank(c, (20, 40, 60, 100))) == [
        None, 1, 2, 2, 3, None, None,
    ]
    closed = lambda c: labels.bin_rank(c, (0, 50, 100), include_lowest=True)
    assert values(spark, [0, 50, 51, -1], closed) == [1, 1, 2, None]
    assert values(spark, [1, 2, None], lambda c: labels.bin_label(c, ("low", "high"))) == ["low", "high", None]


def test_income(spark):
    assert values(spark, [1, 7, 8, 12, 15, 16, -1], labels.bracket_code) == [1, 1, 8, 12, 15, 16, None]
    # the second argument of the original mean is a trim, so the floor is the answer
    assert dict(lookups.INCOME_FLOORS)[2] == 5000.0
    roster = spark.createDataFrame(
        [(1, 2, -1), (1, 2, -1), (2, -1, 3), (3, -1, -1), (4, 16, 1)], "case_id long, income_code int, income_code_alt int"
    )
    got = {x.case_id: x.hh_income for x in demographics.family_income(roster).collect()}
    assert got == {1: 5000.0, 2: 7500.0, 3: None, 4: 150000.0}
    clash = spark.createDataFrame([(1, 2), (1, 3)], "case_id long, income_code int")
    with pytest.raises(Exception, match="conflicting income_code"):
        breakdowns.one_per_case(clash, ["income_code"]).collect()


def test_text(spark):
    short = ["Waiting associated with shopping", "Waiting assoc. w/govt", "x Waiting for/Waiting for/with", None]
    assert values(spark, short, labels.without_waiting_prefix, "x string") == ["shopping", "govt", "x Waiting for/with", None]
    assert values(spark, ["playing GOLF"], labels.sentence_case, "x string") == ["Playing golf"]
    assert values(spark, [1, 2, 9, None], labels.sex_label) == ["Male", "Female", "9", None]
    keep = lambda c: categorize.without_nec(c)
    assert values(spark, ["Grooming, n.e.c.*", "Sleeping", None], keep, "x string") == [False, True, True]


def test_durations(spark):
    minutes = [15.2, 75.9, 119.7, 600.0]
    assert values(spark, minutes, clock.hours_minutes_truncated, "x double") == [" 0:15", " 1:15", " 1:59", "10:00"]
    assert values(spark, minutes, clock.hours_minutes_rounded, "x double") == ["0:15", "1:16", "1:60", "10:00"]
    assert values(spark, [15.2, 75.0, 130.0], clock.duration_in_words, "x double") == [
        "15 minutes", "1 hour, 15 minutes", "2 hours, 10 minutes",
    ]


def test_ratio(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 4.0)], "a double, b double")
    got = df.select(numeric.ratio_or_zero(F.col("a"), F.col("b")), numeric.ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [(0.0, None), (0.25, 0.25)]


# --- breakdowns -----------------------------------------------------------


def test_quantile_over_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    # interpolated 0.3 quantile is 1.9
    assert sorted(r.x for r in breakdowns.at_least_quantile(df, "x", 0.3).collect()) == [2.0, 4.0, 10.0]


def test_score_uses_the_share(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 30.0, 3.0)], "k string, income double, v double")
    rows = breakdowns.share_and_score(df, "k", "v", "income", "share", "score").collect()
    assert {r.share for r in rows} == {0.25, 0.75} and {r.score for r in rows} == {(2.5 + 22.5) / 2}


def test_fuzzy_match_keeps_every_match(spark):
    left = spark.createDataFrame([("Arkansas",), ("Kansas",), ("New York",), ("Northern Mariana Islands",)], "name string")
    right = spark.createDataFrame([("arkansas",), ("kansas",), ("new york",), ("northern mariana islands",)], "region string")
    out = breakdowns.stringdist_left_join(left, right, "name", "region").collect()
    got = sorted((r.name, r.region or "") for r in out)
    assert got == [
        ("Arkansas", "arkansas"), ("Arkansas", "kansas"), ("Kansas", "kansas"), ("New York", "new york"),
        ("Northern Mariana Islands", ""),
    ]
    best = breakdowns.stringdist_left_join(left, right, "name", "region", best_only=True).collect()
    assert ("Arkansas", "kansas") not in {(r.name, r.region) for r in best}


def test_fuzzy_match_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(80)})
    left = spark.createDataFrame([(w,) for w in words[::2]], "a string")
    right = spark.createDataFrame([(w,) for w in words], "b string")
    got = {(r.a, r.b) for r in breakdowns.stringdist_left_join(left, right, "a", "b").collect() if r.b is not None}

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row, last = [i], rows[-1]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
                if i > 1 and j > 1 and (x, y) == (b[j - 2], a[i - 2]):
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    assert got == {(a, b) for a in words[::2] for b in words if distance(a, b) <= 2}


def test_rolling_mean_has_no_edges(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(8)], "k string, i int, v double")
    got = {r.i: r.m for r in breakdowns.rolling_mean(df, ["k"], "i", "v", "m").collect()}
    assert got == {0: None, 1: None, 2: None, 3: 3.0, 4: 4.0, 5: None, 6: None, 7: None}


def test_overall_mean_and_pivot(spark):
    df = spark.createDataFrame([("a", "Male", 1.0, 5.0), ("a", "Female", 3.0, 7.0)], "k string, s string, v double, w double")
    assert {r.m for r in breakdowns.with_overall_mean(df, "v", "m").collect()} == {2.0}
    wide = one(reshape.pivot_values(df, ["k"], "s", ["Male", "Female"], {"v": "", "w": "_w"}))
    assert wide == Row(k="a", Male=1.0, Female=3.0, Male_w=5.0, Female_w=7.0)


def test_profile_counts_missing(spark):
    df = spark.createDataFrame([(1, "x"), (1, None)], "a int, b string")
    got = {(r.column_name, r.value): r.n for r in profile.column_profile(df).collect()}
    assert got == {("a", "1"): 2, ("b", "x"): 1, ("b", None): 1}
    assert profile.column_profile(df, with_null=False).count() == 2


def test_many_labels(spark):
    """More labels than two bytes can number."""
    known = spark.range(70_000).selectExpr("concat('d', id) as description")
    s = spells(spark, [(1, 1, 0, 1440, "d70000"), (2, 1, 0, 1440, "d4464")])
    listed = diary.described(known.unionByName(s.select("description")), "description")
    for got in (
        diary.five_minute_sequence(s, listed),
        diary.one_minute_sequence(s, listed),
        diary.five_minute_slots(s, listed),
    ):
        assert {(r.case_id, r.description) for r in got.collect()} == {(1, "d70000"), (2, "d4464")}


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(diary, "LABEL_SPACE", 4)
    s = spells(spark, [(i, 1, 0, 1440, f"d{i}") for i in range(4)])
    with pytest.raises(Exception, match="4 or more different values"):
        diary.one_minute_sequence(s).collect()
    with pytest.raises(ValueError):
        diary.one_minute_sequence(s, ["a", "b", "c", "d"])


@pytest.mark.parametrize(
    "a,b,n",
    [("", "", 0), ("", "ab", 2), ("ab", "", 2), ("ab", "ba", 1), ("ca", "abc", 3), ("Ohio", "Oiho", 1), ("abcd", "badc", 2),
     ("kitten", "sitting", 3), ("same", "same", 0), ("éa", "aé", 1), ("a", "b", 1)],
)
def test_edit_distance(spark, a, b, n):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert one(df.select(breakdowns.edit_distance(F.col("a"), F.col("b")).alias("d"))).d == n
    assert one(df.select(breakdowns.edit_distance(F.col("b"), F.col("a")).alias("d"))).d == n


def test_swapped_letters_are_one_edit(spark):
    left = spark.createDataFrame([("Maryland",), ("Ohio",)], "name string")
    right = spark.createDataFrame([("Mrayalnd",), ("Oihoo",), ("Iowa",)], "region string")
    got = breakdowns.stringdist_left_join(left, right, "name", "region").collect()
    assert {(r.name, r.region, r.distance) for r in got} == {("Maryland", "Mrayalnd", 2), ("Ohio", "Oihoo", 2)}


# --- codes ----------------------------------------------------------------


def names(spark):
    return spark.createDataFrame(list(ACTIVITY_NAMES), "code string, description string")


@pytest.mark.parametrize("keyword,n", [("wait", 49), ("leisure", 7), ("secu", 20), ("gard", 7), ("files", 0)])
def test_code_keywords(spark, keyword, n):
    assert categorize.codes_named(names(spark), keyword).count() == n


def test_security_without_home(spark):
    codes = categorize.codes_named(names(spark), "secu", exclude=["Home security"])
    assert codes.count() == 19 and codes.filter("activity = 't020905'").count() == 0


@pytest.mark.parametrize("patterns", [lookups.CATEGORIES_V1, lookups.CATEGORIES_V2])
def test_every_code_has_one_category(spark, patterns):
    names = [f"t{code}" for code, _ in ACTIVITY_NAMES]
    header = categorize.label_header(names, patterns)
    assert len(header) == len(names) and all(d for _, d in header)
    codes = spark.createDataFrame([(n,) for n in names], "activity string")
    joined = categorize.regex_left_join(codes, lookups.category_patterns(spark, patterns))
    labelling = Labelling(patterns)
    rows = joined.withColumn("label", labelling.description(F.col("activity"))).collect()
    assert {(r.activity, r.description) for r in rows} == set(header)
    assert all(r.label == r.description for r in rows)


def test_code_check(spark):
    m = facts(spark, [(1, "t0201", 1.0)])
    with pytest.raises(Exception, match="six-digit"):
        categorize.distinct_codes(m).collect()


def test_plain_prefix_equals_regular_expression(spark):
    names = [f"t{code}" for code, _ in ACTIVITY_NAMES] + ["t500101", "t189901", "x"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    for pattern, _ in lookups.CATEGORIES_V1:
        both = df.select(categorize.pattern_hit(F.col("c"), pattern).alias("a"), F.col("c").rlike(pattern).alias("b"))
        assert both.filter("a <> b").count() == 0


@pytest.mark.parametrize("wanted", ["Work", "^Household Activities$", "Caring", "nothing", "."])
def test_codes_among_labels(spark, wanted):
    import re

    names = [f"t{code}" for code, _ in ACTIVITY_NAMES] + ["t990101"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    overlapping = Labelling((("t01.*", "Work"), ("t0101.*", "Sleep"), ("t02.*", "Other"), ("t.*", "Work too")))
    for labelling in (CURATED, overlapping):
        rows = df.select(labelling.description(F.col("c")), labelling.among(F.col("c"), wanted)).collect()
        assert all(kept == (label is not None and bool(re.search(wanted, label))) for label, kept in rows)


ODD_CODES = ["t", "t0", "t01", "t0101", "t010", "xt0101", "t01t0201", "0101", "", "T0101", "t:", "t0100", "t019", "t01999", "t02é"]


@pytest.mark.parametrize(
    "patterns",
    [
        lookups.CATEGORIES_V1,
        lookups.CATEGORIES_V2,
        (("t01.*", "a"), ("t0101.*", "b"), ("t010[1-3].*", "c"), ("t0.*", "a"), ("t.*", "d")),
        (("t01", "a"),),
        (("t01.*", "a"), ("b02.*", "b")),
        (("t01|t02", "a"), ("t02.*", "b")),
        (("tt.*", "a"), ("t02.*", "b")),
    ],
)
def test_prefix_search_equals_one_test_after_the_other(spark, patterns):
    import re

    names = [*(f"t{code}" for code, _ in ACTIVITY_NAMES), *ODD_CODES, None]
    df = spark.createDataFrame([(n,) for n in names], "activity string")
    labelling = Labelling(tuple(patterns))
    rows = df.select(
        "activity",
        labelling.description(F.col("activity")).alias("label"),
        labelling.slot(F.col("activity")).alias("slot"),
        labelling.among(F.col("activity"), "^[ab]$").alias("among"),
    ).collect()
    assert len(rows) == len(names)
    for r in rows:
        hits = [d for p, d in patterns if r.activity is not None and re.search(p, r.activity)]
        assert r.label == (hits[0] if hits else None)
        assert r.slot == labelling.labels.index(r.label)
        assert r.among == (bool(hits) and hits[0] in ("a", "b"))
    joined = categorize.regex_left_join(df, patterns)
    assert joined.columns == ["activity", "pattern", "description"]
    every = [(n, p, d) for n in names for p, d in [x for x in patterns if n is not None and re.search(x[0], n)] or [(None, None)]]
    assert sorted(map(str, map(tuple, joined.collect()))) == sorted(map(str, every))


def test_prefix_search_is_short(spark):
    """A code is compared a few times with bounds, not with every pattern."""
    slot = CURATED.slot(F.col("c"))
    plan = spark.createDataFrame([("t010101",)], "c string").select(slot.alias("s"))._jdf.queryExecution().analyzed().toString()
    depth = most = 0
    for word in plan.replace("CASE", " CASE ").replace("END", " END ").split():
        depth += (word == "CASE") - (word == "END")
        most = max(most, depth)
    assert most <= 10


# --- prefilter ------------------------------------------------------------


def test_prefilter_keeps_all_partners(spark, monkeypatch):
    left = spark.range(4000).selectExpr("id % 1000 as k", "cast(id as string) as s", "id as _word")
    right = spark.range(1000).where("id % 7 = 0").selectExpr("id as k").unionByName(spark.createDataFrame([(None,)], "k long"))
    for words, most in ((1 << 17, 600), (2, 4000)):
        monkeypatch.setattr(prefilter, "WORDS", words)
        kept = prefilter.possibly_in(left, right, ["k"])
        assert kept.columns == left.columns
        n = kept.count()
        assert n <= most and kept.join(right, "k", "left_semi").count() == left.join(right, "k", "left_semi").count() <= n
        assert prefilter.key_bits(left, ["k"]).count() <= words
    assert prefilter.possibly_in(left, right.limit(0), ["k"]).count() == 0


def test_many_labels(spark):
    """Positions are looked up by hash, so that a long list costs a spell no more than a short one."""
    s = spark.range(20_000).selectExpr(
        "id as case_id", "1L as ordinal", "0L as start_min", "1440L as end_min", "concat('label ', id) as description"
    )
    got = diary.one_minute_sequence(s).where("period = 3").agg(F.count("*"), F.countDistinct("description")).first()
    assert tuple(got) == (20_000, 20_000)
    named = diary.one_minute_sequence(s).where("description <> concat('label ', case_id)")
    assert named.count() == 0
    with pytest.raises(Exception, match="not in the label list"):
        diary.one_minute_sequence(s, ["label 1"]).collect()
