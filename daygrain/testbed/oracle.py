"""The registered queries as DuckDB SQL over the same tables.

The SQL follows the definitions literally: codes x groups cells, distinct persons for
participation, one row per minute or five-minute slot for the diaries, every point paired
with every vertex for local regression. It shares no shortcut with the Spark side.
"""

from __future__ import annotations

from collections.abc import Sequence

from daygrain import lookups
from daygrain.operators.estimates import COLLAPSED_LABEL
from daygrain.plans import reports
from daygrain.testbed.queries import WIDE_CODES
from daygrain.testbed import tables
from daygrain.testbed.tables import OUTLIER_YEAR, WORK_DAY_MINUTES


def _text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(name: str, columns: str, rows: Sequence[Sequence]) -> str:
    body = ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


# ---------------------------------------------------------------------------
# Survey-shaped tables
# ---------------------------------------------------------------------------

RESPONDENT = """respondent AS (
  SELECT o_orderkey AS case_id, o_totalprice AS weight, CAST(1 + o_orderkey % 2 AS INT) AS sex,
         CAST(15 + o_custkey % 66 AS INT) AS age, CAST(year(o_orderdate) AS INT) AS year,
         CAST(CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE o_orderkey % 18 END AS INT) AS age_youngest,
         CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END AS INT) AS n_child,
         CAST(1 + o_orderkey % 7 AS INT) AS diary_day,
         CAST(CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS holiday
  FROM orders)"""

FACT = """fact AS (
  SELECT l_orderkey AS case_id,
         't' || lpad(CAST(CASE WHEN l_partkey % 16 = 15 THEN 18 ELSE 1 + l_partkey % 16 END AS VARCHAR), 2, '0')
             || lpad(CAST(1 + l_suppkey % 9 AS VARCHAR), 2, '0')
             || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS code,
         sum(l_quantity) AS spent
  FROM lineitem GROUP BY 1, 2)"""

ROSTER = """roster AS (
  SELECT l_orderkey AS case_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line,
         CAST(1 + l_partkey % 6 AS INT) AS marital, CAST(1 + l_suppkey % 5 AS INT) AS race_code,
         CAST(31 + l_partkey % 16 AS INT) AS educ_code, CAST(1 + l_orderkey % 60 AS INT) AS state_fips,
         CAST(CASE WHEN l_orderkey % 17 = 16 THEN -1 ELSE 1 + l_orderkey % 17 END AS INT) AS income_code,
         CAST(CASE WHEN l_orderkey % 19 > 15 THEN -1 ELSE 1 + l_orderkey % 19 END AS INT) AS income_code_alt
  FROM lineitem)"""

INCOME = "income AS (SELECT DISTINCT case_id, income_code FROM roster)"
FLOORS = _values("floors", "income_code, hh_income", lookups.INCOME_FLOORS)
PATTERNS_V1 = _values("patterns", "pattern, description", lookups.CATEGORIES_V1)
PATTERNS_V2 = _values("patterns", "pattern, description", lookups.CATEGORIES_V2)
NAMES = _values("code_names", "code, description", tables.CODE_NAMES)

MAPPING = """mapping AS (
  SELECT code, pattern, description
  FROM (SELECT DISTINCT code FROM fact) AS codes LEFT JOIN patterns ON regexp_matches(code, pattern))"""

WORK_DAY = f"""worked AS (
  SELECT case_id, sum(spent) >= {WORK_DAY_MINUTES} AS work_day FROM fact WHERE code LIKE '%t05%' GROUP BY 1)"""


def _people(groups: Sequence[str], source: str = "respondent", where: str = "true") -> str:
    columns = "".join(f", {g}" for g in groups)
    return f"people AS (SELECT case_id, weight{columns} FROM {source} WHERE {where})"


def _estimates(groups: Sequence[str], name: str = "est") -> list[str]:
    """Cells over ``people`` (case_id, weight, groups), ``named`` (case_id, label, spent) and
    ``labels`` (label)."""
    g = "".join(f", {x}" for x in groups)
    by = ("GROUP BY " + ", ".join(groups)) if groups else ""
    same = lambda t: "".join(f" AND {t}.{x} IS NOT DISTINCT FROM total.{x}" for x in groups)
    carried = "".join(f", total.{x}" for x in groups)
    return [
        f"total AS (SELECT sum(weight) AS tw{g} FROM people {by})",
        f"num AS (SELECT label, sum(weight * spent) AS wm{g} FROM named JOIN people USING (case_id) GROUP BY label{g})",
        f"""part AS (SELECT label, sum(weight) AS pw{g} FROM (
              SELECT DISTINCT label, case_id, weight{g} FROM named JOIN people USING (case_id) WHERE spent > 0)
            GROUP BY label{g})""",
        f"""{name} AS (
  SELECT labels.label AS activity{carried}, coalesce(wm, 0) / tw AS weighted_minutes,
         coalesce(pw, 0) / tw AS participation_rate,
         CASE WHEN coalesce(pw, 0) = 0 THEN 0 ELSE (wm / tw) / (pw / tw) END AS minutes_per_participant
  FROM total CROSS JOIN (SELECT DISTINCT label FROM labels) AS labels
  LEFT JOIN num ON num.label IS NOT DISTINCT FROM labels.label{same('num')}
  LEFT JOIN part ON part.label IS NOT DISTINCT FROM labels.label{same('part')})""",
    ]


BY_CODE = [
    "named AS (SELECT case_id, code AS label, spent FROM fact)",
    "labels AS (SELECT DISTINCT code AS label FROM fact)",
]
BY_CATEGORY = [
    PATTERNS_V1,
    MAPPING,
    "named AS (SELECT case_id, description AS label, spent FROM fact JOIN mapping USING (code))",
    "labels AS (SELECT description AS label FROM patterns UNION"
    " SELECT description FROM mapping WHERE description IS NULL)",
]
BY_CATEGORY_NO_DATA_CODES = [
    PATTERNS_V1,
    MAPPING,
    f"kept AS (SELECT * FROM mapping WHERE pattern <> '{lookups.DATA_CODES_PATTERN}')",
    "named AS (SELECT case_id, description AS label, spent FROM fact JOIN kept USING (code))",
    f"labels AS (SELECT DISTINCT description AS label FROM patterns WHERE pattern <> '{lookups.DATA_CODES_PATTERN}')",
]


def _collapsed(where: str) -> list[str]:
    label = _text(COLLAPSED_LABEL)
    return [
        f"named AS (SELECT case_id, {label} AS label, spent FROM fact WHERE {where})",
        f"labels AS (SELECT {label} AS label)",
    ]


def _named_like(keyword: str, extra: str = "true") -> str:
    return (
        "code IN (SELECT 't' || code FROM code_names"
        f" WHERE regexp_matches(description, '{keyword}', 'i') AND {extra})"
    )


def _select(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _r(column: str, places: int = 6) -> str:
    return f"round({column}, {places}) AS {column}"


METRICS = ", ".join(_r(m) for m in reports.METRICS)
SEX = "CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex"
METRIC_NAME = """CASE metric WHEN 'weighted_minutes' THEN 'Minutes' WHEN 'participation_rate'
  THEN 'Participation rate' ELSE 'Minutes per participant' END AS name"""


def _estimate_query(groups, label_ctes, body, source="respondent", where="true", extra=()) -> str:
    ctes = [RESPONDENT, FACT, *extra, *label_ctes, _people(groups, source, where), *_estimates(groups)]
    return _select(ctes, body)


def _long(ids: str, metrics: Sequence[str] = reports.METRICS, source: str = "est") -> str:
    return (
        f"SELECT {ids}, {METRIC_NAME}, round(value, 6) AS value"
        f" FROM (UNPIVOT {source} ON {', '.join(metrics)} INTO NAME metric VALUE value)"
    )


def _pivot(keys: str, metrics: dict[str, str], source: str) -> str:
    columns = ", ".join(
        f'max(CASE WHEN sex = {code} THEN {expr} END) AS "{label}{suffix}"'
        for suffix, expr in metrics.items()
        for code, label in ((1, "Male"), (2, "Female"))
    )
    return f"SELECT {keys}, {columns} FROM {source} GROUP BY {keys}"


# ---------------------------------------------------------------------------
# Trends
# ---------------------------------------------------------------------------


def _regression(source: str, groups: Sequence[str], x: str, y: str, knot: bool) -> list[str]:
    """Least squares by successive orthogonal columns, one per step.

    Every basis column loses its projections on the earlier ones; the fit is the sum of the
    projections of y.
    """
    part = "PARTITION BY " + ", ".join(groups)
    p = 5 if knot else 4
    steps = [
        f"""scaled AS (
  SELECT *, 2.0 * ({x} - min({x}) OVER g) / (max({x}) OVER g - min({x}) OVER g) - 1 AS u,
         2.0 * (quantile_cont({x}, 0.5) OVER g - min({x}) OVER g) / (max({x}) OVER g - min({x}) OVER g) - 1 AS k
  FROM {source} WINDOW g AS ({part}))""",
        "q0 AS (SELECT *, CAST(1 AS DOUBLE) AS e0, u AS e1, u * u AS e2, u * u * u AS e3,"
        " greatest(u - k, 0) ** 3 AS e4 FROM scaled)",
    ]
    for i in range(1, p):
        # remove the projection on column i - 1 from every later column
        later = ", ".join(
            f"e{j} - e{i - 1} * sum(e{j} * e{i - 1}) OVER g / sum(e{i - 1} * e{i - 1}) OVER g AS e{j}"
            for j in range(i, 5)
        )
        done = ", ".join(f"e{j}" for j in range(i))
        steps.append(
            f"q{i} AS (SELECT * EXCLUDE ({', '.join(f'e{j}' for j in range(5))}), {done}, {later}"
            f" FROM q{i - 1} WINDOW g AS ({part}))"
        )
    # a column that vanishes adds nothing
    fit = " + ".join(
        f"CASE WHEN sum(e{j} * e{j}) OVER g < 1e-18 THEN 0 ELSE"
        f" e{j} * sum({y} * e{j}) OVER g / sum(e{j} * e{j}) OVER g END"
        for j in range(p)
    )
    steps.append(f"fitted AS (SELECT *, {fit} AS trend FROM q{p - 1} WINDOW g AS ({part}))")
    return steps


def _loess(source: str, groups: Sequence[str], x: str, y: str) -> list[str]:
    """Local quadratic fits at the vertices of a halving of the points, then cubic blending."""
    g = ", ".join(groups)
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in groups)
    pre = lambda t: ", ".join(f"{t}.{c}" for c in groups)
    part = f"PARTITION BY {g}"
    ctes = [
        f"""pts AS (SELECT {g}, CAST({x} AS DOUBLE) AS px, {y} AS py,
  row_number() OVER ({part} ORDER BY {x}) AS rk FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""",
        f"""box0 AS (SELECT {g}, count(*) AS n, min(px) AS lo0, max(px) AS hi0 FROM pts GROUP BY {g})""",
        f"""box AS (SELECT {g}, n, greatest(floor(n * 0.75 * 0.2), 1) AS fc,
  floor(n * 0.75 + 1e-5) AS near,
  lo0 - 0.005 * greatest(hi0 - lo0, greatest(abs(lo0), abs(hi0)) * 1e-3 + 1e-30) AS lo,
  hi0 + 0.005 * greatest(hi0 - lo0, greatest(abs(lo0), abs(hi0)) * 1e-3 + 1e-30) AS hi FROM box0)""",
        f"cell0 AS (SELECT {g}, CAST(1 AS BIGINT) AS l, n AS u, lo AS a, hi AS b, 0.05 * (hi - lo) AS fd, fc FROM box)",
    ]
    for i in range(5):
        ctes.append(
            f"""cut{i} AS (SELECT {pre('c')}, c.l, c.u, c.a, c.b, c.fd, c.fc, (c.l + c.u) // 2 AS m, p.px AS t
  FROM cell{i} AS c JOIN pts AS p ON {on('c', 'p')} AND p.rk = (c.l + c.u) // 2
  WHERE c.u - c.l + 1 > c.fc AND c.b - c.a > c.fd)"""
        )
        ctes.append(
            f"""cell{i + 1} AS (SELECT {g}, l, m AS u, a, t AS b, fd, fc FROM cut{i}
  UNION ALL SELECT {g}, m + 1, u, t, b, fd, fc FROM cut{i})"""
        )
    cuts = " UNION ".join(f"SELECT {g}, t AS v FROM cut{i}" for i in range(5))
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
    ctes += [
        f"vertex AS (SELECT {g}, lo AS v FROM box UNION SELECT {g}, hi FROM box UNION {cuts})",
        f"""dist AS (SELECT {pre('p')}, vertex.v, p.px, p.py, abs(p.px - vertex.v) AS d, box.near,
  row_number() OVER (PARTITION BY {pre('p')}, vertex.v ORDER BY abs(p.px - vertex.v)) AS place
  FROM vertex JOIN pts AS p ON {on('vertex', 'p')} JOIN box ON {on('box', 'p')})""",
        f"wide AS (SELECT {g}, v, max(d) AS h FROM dist WHERE place <= near GROUP BY {g}, v)",
        f"""wgt AS (SELECT {pre('dist')}, dist.v, h, py, (px - dist.v) / h AS z, (1 - (d / h) ** 3) ** 3 AS w
  FROM dist JOIN wide ON {on('dist', 'wide')} AND dist.v = wide.v WHERE d < h)""",
        f"""mom AS (SELECT {g}, v, h, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * z ** 3) AS s3,
  sum(w * z ** 4) AS s4, sum(w * py) AS t0, sum(w * z * py) AS t1, sum(w * z * z * py) AS t2
  FROM wgt GROUP BY {g}, v, h)""",
        f"""fit AS (SELECT {g}, v,
  (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {det} AS val,
  (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {det} / h AS slope
  FROM mom)""",
        f"""piece AS (SELECT {g}, v AS v0, val AS f0, slope AS d0, lead(v) OVER o AS v1, lead(val) OVER o AS f1,
  lead(slope) OVER o AS d1 FROM fit WINDOW o AS ({part} ORDER BY v))""",
        f"""smooth AS (SELECT {pre('p')}, p.px,
  (1 - z) ** 2 * (1 + 2 * z) * f0 + z * z * (3 - 2 * z) * f1
  + z * (1 - z) ** 2 * (v1 - v0) * d0 - z * z * (1 - z) * (v1 - v0) * d1 AS trend
  FROM (SELECT {pre('p')}, p.px, (p.px - v0) / (v1 - v0) AS z, v0, v1, f0, f1, d0, d1
        FROM pts AS p JOIN piece ON {on('p', 'piece')} AND p.px >= v0 AND p.px < v1) AS p)""",
        f"""fitted AS (SELECT s.*, smooth.trend FROM {source} AS s
  LEFT JOIN smooth ON {on('s', 'smooth')} AND s.{x} = smooth.px)""",
    ]
    return ctes


# ---------------------------------------------------------------------------
# Diaries
# ---------------------------------------------------------------------------

SPELL = """ev AS (
  SELECT user_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS dy, event_type AS description, event_id,
         CAST((hour(ts) * 60 + minute(ts) + 1200) % 1440 AS INT) AS start_min
  FROM events),
ev_next AS (
  SELECT *, lead(start_min) OVER (PARTITION BY user_id, dy ORDER BY start_min, event_id) AS nxt FROM ev),
spell AS (
  SELECT user_id * 100 + day(dy) AS case_id, event_id AS ordinal, description, dy,
         (start_min + 240) % 1440 AS start_clock,
         (coalesce(nxt, CASE WHEN user_id % 10 = 0 THEN greatest(start_min, 1439) ELSE 1440 END) + 240) % 1440
           AS stop_clock
  FROM ev_next)"""

DIARY_DAY = """diary_day AS (
  SELECT DISTINCT case_id, CAST(dayofweek(dy) + 1 AS INT) AS diary_day,
         CAST(dy = DATE '2024-01-01' AS INT) AS holiday, CAST(year(dy) AS INT) AS diary_year FROM spell)"""

WEEKDAY_SPELL = """spell5 AS (
  SELECT case_id, ordinal, description, s AS start_min, CASE WHEN e < s THEN 1435 ELSE e END AS end_min
  FROM (SELECT *, (start_clock // 5 * 5 + 1200) % 1440 AS s, (stop_clock // 5 * 5 + 1200) % 1440 AS e FROM spell)
  WHERE case_id IN (SELECT case_id FROM diary_day WHERE diary_day BETWEEN 2 AND 6 AND holiday = 0))"""

SLOT5 = """slot5 AS (
  SELECT case_id, slot AS minute, arg_min(description, ordinal) AS description
  FROM (SELECT case_id, description, ordinal, unnest(generate_series(start_min, end_min, 5)) AS slot FROM spell5)
  GROUP BY 1, 2)"""


def _modes(source: str, out: str) -> str:
    """Most frequent description per half hour, the earliest one on a tie."""
    return f"""{out} AS (
  SELECT case_id, CAST(period AS INT) AS period, description FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, period ORDER BY n DESC, first_at) AS rn FROM (
      SELECT case_id, minute // 30 + 1 AS period, description, count(*) AS n, min(minute) AS first_at
      FROM {source} WHERE description IS NOT NULL GROUP BY ALL))
  WHERE rn = 1)"""


SPELL1 = """spell1 AS (
  SELECT case_id, ordinal, description, s AS start_min, CASE WHEN e < s THEN 1440 ELSE e END AS end_min
  FROM (SELECT *, (start_clock + 1200) % 1440 AS s, (stop_clock + 1200) % 1440 AS e FROM spell))"""
WHOLE = "whole AS (SELECT case_id FROM spell1 GROUP BY 1 HAVING max(end_min) = 1440)"
MINUTE = """per_minute AS (
  SELECT case_id, description, unnest(range(start_min, end_min)) AS minute FROM spell1
  WHERE case_id IN (SELECT case_id FROM whole) AND end_min > start_min)"""

# ---------------------------------------------------------------------------
# Demographics
# ---------------------------------------------------------------------------

STATES = _values("states", "name, state, fips", lookups.STATES)

RESPONDENT_LINE = """line_one AS (
  SELECT case_id, CAST(marital = 1 AS INT) AS married,
         CASE WHEN race_code = 1 THEN 'white' WHEN race_code = 2 THEN 'black' WHEN race_code = 4 THEN 'asian'
              ELSE 'other' END AS race,
         CASE WHEN educ_code < 38 THEN 'Did not graduate from HS' WHEN educ_code = 39 THEN 'HS'
              WHEN educ_code IN (40, 41, 42) THEN 'Some college' WHEN educ_code = 43 THEN 'Bachelors'
              WHEN educ_code = 44 THEN 'Masters' WHEN educ_code = 45 THEN 'Doctoral' END AS education,
         states.name AS state
  FROM roster LEFT JOIN states ON state_fips = fips WHERE line = 1)"""

FAMILY_INCOME = """family AS (
  SELECT case_id, greatest(a.hh_income, b.hh_income) AS hh_income
  FROM (SELECT DISTINCT case_id, income_code, income_code_alt FROM roster) AS codes
  LEFT JOIN floors AS a ON codes.income_code = a.income_code
  LEFT JOIN floors AS b ON codes.income_code_alt = b.income_code)"""

DEMOGRAPHICS = """demo AS (
  SELECT r.case_id, weight AS survey_weight, age, sex, nullif(age_youngest, -1) AS age_youngest, n_child,
         CAST(hh_income AS DOUBLE) AS hh_income, married, race, education, state,
         CAST(coalesce(nullif(age_youngest, -1) < 12, false) AS INT) AS child_under_12
  FROM respondent AS r LEFT JOIN family USING (case_id) LEFT JOIN line_one USING (case_id)
  WHERE r.case_id IN (SELECT case_id FROM population))"""

DEMO_CTES = [RESPONDENT, ROSTER, FLOORS, STATES, RESPONDENT_LINE, FAMILY_INCOME]
WEEKEND_POPULATION = "population AS (SELECT case_id FROM respondent WHERE diary_day IN (1, 7) AND holiday = 0)"
PROFILED = (
    "case_id", "survey_weight", "age", "sex", "age_youngest", "n_child", "hh_income", "married", "race", "education", "state", "child_under_12",
)


# ---------------------------------------------------------------------------
# Income
# ---------------------------------------------------------------------------

BRACKETED = """bracketed AS (
  SELECT respondent.*, hh_income FROM respondent
  LEFT JOIN income USING (case_id)
  LEFT JOIN floors ON floors.income_code = CASE
    WHEN income.income_code BETWEEN 1 AND 7 THEN 1 WHEN income.income_code BETWEEN 8 AND 11 THEN 8
    WHEN income.income_code BETWEEN 12 AND 14 THEN 12 ELSE income.income_code END
  WHERE income.income_code <> -1)"""

WITH_INCOME = """with_income AS (
  SELECT respondent.*, hh_income,
         CASE WHEN hh_income >= 0 AND hh_income <= 50000 THEN 1 WHEN hh_income > 50000 AND hh_income <= 100000 THEN 2
              WHEN hh_income > 100000 AND hh_income <= 150000 THEN 3 END AS income_rank,
         coalesce(work_day, false) AS work_day
  FROM respondent LEFT JOIN income USING (case_id) LEFT JOIN floors USING (income_code)
  LEFT JOIN worked USING (case_id))"""

BRACKETS = _values(
    "brackets",
    "hh_income, income_label, income_rank",
    [(dict(lookups.INCOME_FLOORS)[lo], label, i) for i, (lo, _, label) in enumerate(lookups.INCOME_BRACKETS, 1)],
)


def _shares(metric: str, where: str, keep: str, description: str) -> str:
    ctes = [
        RESPONDENT, FACT, ROSTER, INCOME, FLOORS, BRACKETED, NAMES, BRACKETS,
        f"named AS (SELECT case_id, code AS label, spent FROM fact WHERE {where})",
        "labels AS (SELECT DISTINCT label FROM named)",
        _people(["hh_income"], "bracketed"),
        *_estimates(["hh_income"]),
        f"tot AS (SELECT activity, hh_income, {metric} AS metric, sum({metric}) OVER (PARTITION BY activity) AS total FROM est)",
        "kept AS (SELECT tot.*, code_names.description FROM tot LEFT JOIN code_names ON activity = 't' || code"
        f" WHERE total >= (SELECT quantile_cont(total, 0.3) FROM tot) AND {keep})",
        "shared AS (SELECT *, CASE WHEN sum(metric) OVER (PARTITION BY activity) = 0 THEN NULL"
        " ELSE metric / sum(metric) OVER (PARTITION BY activity) END AS part FROM kept)",
    ]
    return _select(
        ctes,
        f"""SELECT activity, {description} AS description, CAST(shared.hh_income AS DOUBLE) AS hh_income, income_label,
       CAST(income_rank AS INT) AS income_rank, round(part, 6) AS share,
       round(avg(shared.hh_income * part) OVER (PARTITION BY activity), 6) AS mean_income
FROM shared LEFT JOIN brackets USING (hh_income)""",
    )


def _without_prefixes(column: str) -> str:
    for prefix in lookups.WAITING_PREFIXES:
        # without the global flag only the first match goes
        column = f"regexp_replace({column}, {_text(prefix.replace('.', chr(92) + '.'))}, '')"
    return column


# ---------------------------------------------------------------------------
# Replicates
# ---------------------------------------------------------------------------


def _replicates(groups: Sequence[str], where: str, extra: Sequence[str], head: str) -> str:
    g = ", ".join(groups)
    ctes = [
        RESPONDENT, FACT, *extra,
        f"person AS (SELECT r.case_id, weight, {g}, coalesce(spent, 0) AS spent FROM respondent AS r LEFT JOIN"
        f" (SELECT case_id, sum(spent) AS spent FROM fact WHERE {where} GROUP BY 1) AS t USING (case_id))",
        f"""rep AS (SELECT {g}, r, sum(w * spent) / sum(w) AS theta FROM (
  SELECT {g}, spent, r, weight * CASE WHEN ((case_id % 1009) * (r + 17) + r * r) % 1009 % 2 = 0 THEN 0.5 ELSE 1.5 END AS w
  FROM person CROSS JOIN range(1, 161) AS replicates(r)) GROUP BY {g}, r)""",
        f"base AS (SELECT {g}, sum(weight * spent) / sum(weight) AS weighted_minutes FROM person GROUP BY {g})",
        f"""se AS (SELECT {g}, weighted_minutes, sqrt(4.0 / 160 * sum((theta - weighted_minutes) ** 2)) AS se
  FROM rep JOIN base USING ({g}) GROUP BY {g}, weighted_minutes)""",
    ]
    return _select(
        ctes,
        f"""SELECT {_text(COLLAPSED_LABEL)} AS activity, {head}, {_r('weighted_minutes')}, {_r('se')},
  round(weighted_minutes - 2 * se, 6) AS lower, round(weighted_minutes + 2 * se, 6) AS upper FROM se""",
    )


# ---------------------------------------------------------------------------
# Registered SQL
# ---------------------------------------------------------------------------

TV = f"code IN {_in(lookups.TV_CODES)}"
COOKING = f"code IN {_in(lookups.COOKING_CODES)}"
GROCERY = f"code IN {_in(lookups.GROCERY_CODES)}"
HOUSEHOLD = "code IN (SELECT code FROM mapping WHERE description = 'Household Activities')"
WORKING = "code IN (SELECT code FROM mapping WHERE description LIKE '%Work%')"
TV_EST = [RESPONDENT, FACT, *_collapsed(TV), _people(["age", "sex"]), *_estimates(["age", "sex"])]
COMPUTER = f"code = '{lookups.COMPUTER_LEISURE_CODE}'"
COMPUTER_EST = [RESPONDENT, FACT, *_collapsed(COMPUTER), _people(["age", "year"]), *_estimates(["age", "year"])]
COMPUTER_POINTS = "pts0 AS (SELECT age, year, weighted_minutes AS total_minutes FROM est)"

AGE_BIN = """binned AS (SELECT *, CASE WHEN age > 20 AND age <= 40 THEN 'Age 20-40' WHEN age > 40 AND age <= 60
  THEN '40-60' WHEN age > 60 AND age <= 100 THEN '60+' END AS age_group FROM respondent WHERE age > 20)"""


def _agebin(where: str, extra: Sequence[str], tail: Sequence[str] = (), body: str | None = None) -> str:
    groups = ["sex", "year", "age_group"]
    ctes = [
        RESPONDENT, FACT, *extra, AGE_BIN, *_collapsed(where), _people(groups, "binned"), *_estimates(groups),
        f"labelled AS (SELECT {SEX}, year, age_group, weighted_minutes, participation_rate FROM est)",
        f"long AS (SELECT sex, year, age_group, {METRIC_NAME}, value, sex || '-' || age_group AS grouping"
        " FROM (UNPIVOT labelled ON weighted_minutes, participation_rate INTO NAME metric VALUE value))",
        *tail,
    ]
    return _select(ctes, body or "SELECT sex, year, age_group, name, round(value, 6) AS value, grouping FROM long")


def _by_year(where: str, extra=(), people_where: str = "true", body: str | None = None) -> str:
    ctes = [
        RESPONDENT, FACT, *extra, *_collapsed(where), _people(["year"], where=people_where), *_estimates(["year"]),
    ]
    return _select(ctes, body or _long("activity, year"))


def _by_sex_age(where: str) -> str:
    ctes = [
        RESPONDENT, FACT, *_collapsed(where), _people(["sex", "age"]), *_estimates(["sex", "age"]),
        f"labelled AS (SELECT * EXCLUDE (sex), {SEX} FROM est)",
    ]
    return _select(ctes, _long("activity, sex, age", source="labelled"))


BY_WORKDAY = [
    RESPONDENT, FACT, WORK_DAY, *BY_CATEGORY,
    "flagged AS (SELECT respondent.*, coalesce(work_day, false) AS work_day FROM respondent LEFT JOIN worked USING (case_id))",
    _people(["age", "work_day"], "flagged"),
    *_estimates(["age", "work_day"]),
    "by_workday AS (SELECT activity, age, CASE WHEN work_day THEN 'Work day' ELSE 'Leisure day' END AS work_day,"
    " weighted_minutes FROM est)",
]
HOME = f"activity IN {_in(lookups.HOME_CATEGORIES)}"

INCOME_AGE = [
    RESPONDENT, FACT, ROSTER, INCOME, FLOORS, WORK_DAY, WITH_INCOME, *BY_CATEGORY_NO_DATA_CODES,
    _people(["income_rank", "age", "work_day"], "with_income"),
    *_estimates(["income_rank", "age", "work_day"]),
    """income_age AS (SELECT activity AS description, CAST(income_rank AS INT) AS income_rank, age, weighted_minutes,
  CASE income_rank WHEN 1 THEN '$0-50k' WHEN 2 THEN '$50-100k' ELSE '$100-150k' END AS income_label
  FROM est WHERE work_day AND income_rank IS NOT NULL)""",
]

STATE_EST = [
    RESPONDENT, FACT, NAMES,
    "located AS (SELECT respondent.*, c_nationkey AS state_id FROM respondent LEFT JOIN"
    " (SELECT o_orderkey AS case_id, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) USING (case_id))",
    *_collapsed(_named_like("leisure")),
    _people(["state_id"], "located"),
    *_estimates(["state_id"]),
    "by_state AS (SELECT state_id, weighted_minutes AS total_leisure, n_name AS name FROM est"
    " JOIN nation ON state_id = n_nationkey)",
]

MINUTES_TEXT = """SELECT age, sex,
  printf('%2d:%02d', CAST(floor(weighted_minutes / 60) AS INT), CAST(floor(weighted_minutes - 60 * floor(weighted_minutes / 60)) AS INT)) AS axis_label,
  printf('%d:%02d', h, m) AS clock_label,
  CASE h WHEN 0 THEN printf('%d minutes', m) WHEN 1 THEN printf('1 hour, %d minutes', m)
         ELSE printf('%d hours, %d minutes', h, m) END AS words
FROM (SELECT age, CASE sex WHEN 1 THEN 'Male' ELSE 'Female' END AS sex, weighted_minutes,
             CAST(floor(weighted_minutes / 60) AS INT) AS h,
             CAST(floor(weighted_minutes - 60 * floor(weighted_minutes / 60) + 0.5) AS INT) AS m FROM est)"""

WIDE_LABELS = [
    "named AS (SELECT case_id, code AS label, spent FROM fact)",
    f"labels AS (SELECT unnest([{', '.join(_text(c) for c in WIDE_CODES)}]) AS label)",
]

WIDE_CATEGORY = [
    *BY_CATEGORY[:3],
    f"codes AS (SELECT unnest([{', '.join(_text(c) for c in WIDE_CODES)}]) AS code)",
    "labels AS (SELECT DISTINCT description AS label FROM codes LEFT JOIN patterns ON regexp_matches(code, pattern))",
]

HOURS = """SELECT activity, {sex}, round(weighted_minutes / 60, 2) AS weighted_hours,
  round(participation_rate, 4) AS participation_rate, round(minutes_per_participant / 60, 2) AS hours_per_participant
FROM est"""

DAYS = [SPELL, DIARY_DAY, WEEKDAY_SPELL, SLOT5]

TIER1 = _values("tier1", "code, description", lookups.TIER1_NAMES)
BY_TIER1 = [
    TIER1,
    "named AS (SELECT case_id, tier1.description AS label, spent FROM fact"
    " LEFT JOIN tier1 ON substr(fact.code, 2, 2) = tier1.code)",
    "labels AS (SELECT DISTINCT label FROM named)",
]

ORACLE: dict[str, str] = {
    "weighted_minutes_by_activity": _estimate_query([], BY_CODE, f"SELECT activity, {_r('weighted_minutes')} FROM est"),
    "weighted_minutes_by_group": _estimate_query(
        ["sex", "year"], BY_CODE, f"SELECT activity, sex, year, {_r('weighted_minutes')} FROM est"
    ),
    "weighted_minutes_all_collapsed": _estimate_query(
        ["sex"], _collapsed("true"), f"SELECT activity, sex, {_r('weighted_minutes')} FROM est"
    ),
    "weighted_minutes_by_category": _estimate_query(
        ["sex", "age"], BY_CATEGORY, f"SELECT activity, sex, age, {_r('weighted_minutes')} FROM est"
    ),
    "weighted_minutes_by_mapping": _estimate_query(["sex"], BY_TIER1, f"SELECT activity, sex, {METRICS} FROM est"),
    "weighted_minutes_pivot_sex": _estimate_query(
        ["sex"], BY_CATEGORY, _pivot("activity", {"": "round(weighted_minutes / 60, 2)"}, "est")
    ),
    "metrics_pivot_sex": _estimate_query(
        ["sex"],
        BY_CATEGORY,
        _pivot(
            "activity",
            {
                "_weighted_hours": "round(weighted_minutes / 60, 2)",
                "_participation_rate": "round(participation_rate, 4)",
                "_hours_per_participant": "round(minutes_per_participant / 60, 2)",
            },
            "est",
        ),
    ),
    "participation_by_activity": _estimate_query([], BY_CODE, f"SELECT activity, {_r('participation_rate')} FROM est"),
    "participation_by_category": _estimate_query(
        ["sex"], BY_CATEGORY, f"SELECT activity, sex, {_r('participation_rate')} FROM est"
    ),
    "minutes_per_participant_by_sex": _estimate_query(
        ["sex"], BY_CATEGORY, f"SELECT activity, {SEX}, {METRICS} FROM est"
    ),
    "summary_by_sex": _estimate_query(["sex"], BY_CATEGORY, HOURS.format(sex=SEX)),
    "category_by_sex": _estimate_query(
        ["sex"], BY_CATEGORY_NO_DATA_CODES, f"SELECT activity AS description, {SEX}, {_r('weighted_minutes')} FROM est"
    ),
    "wide_unpivot": _select(
        [FACT],
        "SELECT case_id, code AS activity, round(spent, 6) AS minutes FROM fact"
        " WHERE spent > 0 AND case_id IN (SELECT o_orderkey FROM orders)",
    ),
    "wide_estimates": _estimate_query(["sex", "year"], WIDE_LABELS, f"SELECT activity, sex, year, {METRICS} FROM est"),
    "wide_minutes": _estimate_query(["sex"], WIDE_CATEGORY, f"SELECT activity, sex, {_r('weighted_minutes')} FROM est"),
    "wide_participation": _estimate_query(
        ["year"], WIDE_CATEGORY, f"SELECT activity, year, {_r('participation_rate')} FROM est"
    ),
    "wide_standard_errors": _replicates(["sex"], "code LIKE 't12%'", (), "sex"),
    "tv_by_age_sex": _select(TV_EST, f"SELECT activity, age, {SEX}, {_r('weighted_minutes')} FROM est"),
    "trend_cubic": _select(
        [*TV_EST, *_regression("est", ["sex"], "age", "weighted_minutes", knot=False)],
        f"SELECT age, {SEX}, {_r('weighted_minutes')}, {_r('trend')} FROM fitted",
    ),
    "trend_loess": _select(
        [*TV_EST, *_loess("est", ["sex"], "age", "weighted_minutes")],
        _pivot("age", {"": "round(weighted_minutes, 6)", "_smooth": "round(trend, 6)"}, "fitted"),
    ),
    "trend_spline4": _select(
        [
            *BY_WORKDAY,
            f"home AS (SELECT * FROM by_workday WHERE {HOME})",
            *_regression("home", ["activity", "work_day"], "age", "weighted_minutes", knot=True),
        ],
        f"SELECT activity, age, work_day, {_r('weighted_minutes')}, {_r('trend')} FROM fitted",
    ),
    "income_age_spline": _select(
        [*INCOME_AGE, *_regression("income_age", ["description", "income_rank"], "age", "weighted_minutes", knot=True)],
        f"SELECT description, income_rank, age, {_r('weighted_minutes')}, income_label, {_r('trend')} FROM fitted",
    ),
    "minutes_formatted": _select(TV_EST, MINUTES_TEXT),
    "age_extent": _select([RESPONDENT], "SELECT min(age) AS min_age, max(age) AS max_age FROM respondent"),
    "replicate_se_by_age_sex": _replicates(["age", "sex"], TV, (), f"age, {SEX}"),
    "replicate_se_by_year": _replicates(["year"], _named_like("leisure"), (NAMES,), "year"),
    "metrics_by_sex_year_agebin": _agebin(HOUSEHOLD, (PATTERNS_V1, MAPPING)),
    "cooking_grocery_by_sex_year_agebin": _agebin(f"({COOKING} OR {GROCERY})", ()),
    "metrics_long_by_year": _by_year(WORKING, (PATTERNS_V1, MAPPING)),
    "job_search_by_year": _by_year(f"code IN {_in(lookups.JOB_SEARCH_CODES)}"),
    "garden_by_year_age_range": _by_year(_named_like("gard"), (NAMES,), "age >= 20 AND age <= 40"),
    "security_per_participant_by_year": _by_year(
        _named_like("secu", "description <> 'Home security'"),
        (NAMES,),
        body=f"SELECT activity, year, {METRICS} FROM est WHERE year <> {OUTLIER_YEAR}",
    ),
    "cooking_by_sex_age": _by_sex_age(COOKING),
    "grocery_by_sex_age": _by_sex_age(GROCERY),
    "category_by_age_workday": _select(
        BY_WORKDAY, f"SELECT activity, age, work_day, {_r('weighted_minutes')} FROM by_workday"
    ),
    "home_activities_by_age_workday": _select(
        BY_WORKDAY, f"SELECT activity, age, work_day, {_r('weighted_minutes')} FROM by_workday WHERE {HOME}"
    ),
    "sports_share_by_income": _shares(
        "participation_rate",
        f"code BETWEEN '{lookups.SPORTS_CODE_RANGE[0]}' AND '{lookups.SPORTS_CODE_RANGE[1]}'",
        r"NOT coalesce(regexp_matches(code_names.description, 'n\.e\.c'), false)",
        "description",
    ),
    "waiting_share_by_income": _shares(
        "weighted_minutes",
        _named_like("wait"),
        r"NOT coalesce(regexp_matches(code_names.description, 'n\.e\.c'), false)",
        f"'... ' || {_without_prefixes('description')}",
    ),
    "waiting_share_participants": _shares(
        "minutes_per_participant",
        _named_like("wait"),
        "true",
        f"upper(left({_without_prefixes('description')}, 1)) || lower(substr({_without_prefixes('description')}, 2))",
    ),
    "category_by_income": _estimate_query(
        ["hh_income"],
        BY_CATEGORY_NO_DATA_CODES,
        f"SELECT activity AS description, CAST(hh_income AS DOUBLE) AS hh_income, {_r('weighted_minutes')} FROM est",
        source="with_income",
        extra=(ROSTER, INCOME, FLOORS, WORK_DAY, WITH_INCOME),
    ),
    "category_by_incomebin_age": _select(
        INCOME_AGE, f"SELECT description, income_rank, age, {_r('weighted_minutes')}, income_label FROM income_age"
    ),
    "leisure_by_state": _select(STATE_EST, f"SELECT state_id, {_r('total_leisure')}, name FROM by_state"),
    "leisure_by_state_region": _select(
        STATE_EST,
        f"""SELECT by_state.name, state_id, {_r('total_leisure')}, r_name AS region,
  round(avg(total_leisure) OVER (), 6) AS mean_leisure
FROM by_state JOIN nation ON state_id = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "state_fuzzy_match": _select(
        [*STATE_EST, "map_names AS (SELECT replace(n_name, 'NATION', 'NATIO') AS region_name FROM nation)"],
        f"""SELECT name, state_id, {_r('total_leisure')}, region_name,
  CAST(damerau_levenshtein(name, region_name) AS INT) AS distance
FROM by_state LEFT JOIN map_names ON damerau_levenshtein(name, region_name) <= 2""",
    ),
    "computer_use_by_age_year": _select(
        COMPUTER_EST, "SELECT age, year, round(weighted_minutes, 6) AS total_minutes FROM est"
    ),
    "computer_use_loess": _select(
        [*COMPUTER_EST, COMPUTER_POINTS, *_loess("pts0", ["year"], "age", "total_minutes")],
        f"SELECT age, year, {_r('total_minutes')}, {_r('trend')} FROM fitted",
    ),
    "rolling_mean_age": _select(
        COMPUTER_EST,
        """SELECT age, year, round(weighted_minutes, 6) AS total_minutes,
  CASE WHEN count(*) OVER w = 7 THEN round(avg(weighted_minutes) OVER w, 6) END AS rolling
FROM est WINDOW w AS (PARTITION BY year ORDER BY age ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ),
    "code_catalogue": _estimate_query(
        [],
        BY_CODE,
        """SELECT substr(activity, 2) AS code, n.description AS official_name,
  tier1.description AS official_summary_category, mapping.description AS suggested_categorization,
  round(weighted_minutes, 2) AS average_minutes, round(minutes_per_participant, 2) AS avg_minutes_per_participant,
  round(participation_rate, 2) AS participation_rate
FROM est JOIN mapping ON mapping.code = activity LEFT JOIN code_names AS n ON activity = 't' || n.code
LEFT JOIN tier1 ON substr(activity, 2, 2) = tier1.code""",
        extra=(PATTERNS_V2, MAPPING, NAMES, TIER1),
    ),
    "weekend_minutes_long": _select(
        [RESPONDENT, FACT, PATTERNS_V2, MAPPING],
        """SELECT r.case_id, c.description, coalesce(round(total, 6), 0) AS minutes
FROM (SELECT case_id FROM respondent WHERE diary_day IN (1, 7) AND holiday = 0) AS r
CROSS JOIN (SELECT DISTINCT description FROM patterns) AS c
LEFT JOIN (SELECT case_id, description, sum(spent) AS total FROM fact JOIN mapping USING (code) GROUP BY 1, 2) AS t
  ON t.case_id = r.case_id AND t.description IS NOT DISTINCT FROM c.description""",
    ),
    "diary_minutes_normalised": _select(
        [SPELL, SPELL1],
        "SELECT case_id, ordinal, description, CAST(start_min AS INT) AS start_min, CAST(end_min AS INT) AS end_min FROM spell1",
    ),
    "diary_slots_5min": _select(DAYS, "SELECT case_id, CAST(minute AS INT) AS minute, description FROM slot5"),
    "diary_slots_5min_complete": _select(
        DAYS,
        """SELECT ids.case_id, CAST(grid.minute AS INT) AS minute, slot5.description
FROM (SELECT DISTINCT case_id FROM slot5) AS ids CROSS JOIN (SELECT unnest(range(0, 1440, 5)) AS minute) AS grid
LEFT JOIN slot5 ON slot5.case_id = ids.case_id AND slot5.minute = grid.minute""",
    ),
    "diary_sequence_5min": _select([*DAYS, _modes("slot5", "seq")], "SELECT case_id, period, description FROM seq"),
    "diary_whole_day_ids": _select([SPELL, SPELL1, WHOLE], "SELECT case_id FROM whole"),
    "diary_sequence_1min": _select(
        [SPELL, SPELL1, WHOLE, MINUTE, _modes("per_minute", "seq")], "SELECT case_id, period, description FROM seq"
    ),
    "demographics_weekend": _select([*DEMO_CTES, WEEKEND_POPULATION, DEMOGRAPHICS], "SELECT * FROM demo"),
    "demographics_weekday": _select(
        [
            *DEMO_CTES, *DAYS, _modes("slot5", "seq"), "population AS (SELECT DISTINCT case_id FROM seq)", DEMOGRAPHICS,
        ],
        "SELECT * FROM demo",
    ),
    "demographics_full": _select(
        [
            *DEMO_CTES, SPELL, DIARY_DAY, SPELL1, WHOLE, MINUTE, _modes("per_minute", "seq"),
            "population AS (SELECT DISTINCT case_id FROM seq)", DEMOGRAPHICS,
        ],
        "SELECT demo.*, diary_day AS day_of_week, holiday, diary_year FROM demo LEFT JOIN diary_day USING (case_id)",
    ),
    "column_profile": _select(
        [
            *DEMO_CTES, WEEKEND_POPULATION, DEMOGRAPHICS,
            "cells AS ("
            + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM demo" for c in PROFILED)
            + ")",
        ],
        "SELECT column_name, value, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY 1, 2",
    ),
}

ORACLE["sex_gap_wide"] = _select(
    TV_EST,
    """SELECT age, round("M", 6) AS "Male", round("F", 6) AS "Female", round("M" - "F", 6) AS gap FROM (
  SELECT age, max(CASE WHEN sex = 1 THEN weighted_minutes END) AS "M",
         max(CASE WHEN sex = 2 THEN weighted_minutes END) AS "F" FROM est GROUP BY age)""",
)


def _year_trend(where: str, extra: Sequence[str] = (), people_where: str = "true") -> str:
    ctes = [
        RESPONDENT, FACT, *extra, *_collapsed(where), _people(["year"], where=people_where), *_estimates(["year"]),
        f"long AS (SELECT activity, year, {METRIC_NAME}, value FROM"
        " (UNPIVOT est ON weighted_minutes, participation_rate, minutes_per_participant INTO NAME metric VALUE value))",
        *_loess("long", ["name"], "year", "value"),
    ]
    return _select(ctes, f"SELECT activity, year, name, {_r('value')}, {_r('trend')} FROM fitted")


def _sex_age_trend(where: str) -> str:
    ctes = [
        RESPONDENT, FACT, *_collapsed(where), _people(["sex", "age"]), *_estimates(["sex", "age"]),
        f"long AS (SELECT activity, {SEX}, age, {METRIC_NAME}, value FROM"
        " (UNPIVOT est ON weighted_minutes, participation_rate, minutes_per_participant INTO NAME metric VALUE value))",
        *_loess("long", ["sex", "name"], "age", "value"),
    ]
    return _select(ctes, f"SELECT activity, sex, age, name, {_r('value')}, {_r('trend')} FROM fitted")


ORACLE["trend_loess_by_group"] = _year_trend(WORKING, (PATTERNS_V1, MAPPING))
ORACLE["job_search_trend"] = _year_trend(f"code IN {_in(lookups.JOB_SEARCH_CODES)}")
ORACLE["garden_trend"] = _year_trend(_named_like("gard"), (NAMES,), "age >= 20 AND age <= 40")
ORACLE["cooking_trend"] = _sex_age_trend(COOKING)
ORACLE["grocery_trend"] = _sex_age_trend(GROCERY)
ORACLE["category_spline"] = _select(
    [*BY_WORKDAY, *_regression("by_workday", ["activity", "work_day"], "age", "weighted_minutes", knot=True)],
    f"SELECT activity, age, work_day, {_r('weighted_minutes')}, {_r('trend')} FROM fitted",
)
ORACLE["cooking_grocery_trend"] = _agebin(
    f"({COOKING} OR {GROCERY})",
    (),
    _loess("long", ["grouping", "name"], "year", "value"),
    f"SELECT sex, year, age_group, name, {_r('value')}, grouping, {_r('trend')} FROM fitted",
)
ORACLE["household_trend"] = _agebin(
    HOUSEHOLD,
    (PATTERNS_V1, MAPPING),
    _loess("long", ["grouping", "name"], "year", "value"),
    f"SELECT sex, year, age_group, name, {_r('value')}, grouping, {_r('trend')} FROM fitted",
)
