"""Activity codes: pattern matching, code sets and names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain import lookups

CODE_FORMAT = "^t[0-9]{6}$"


def distinct_codes(minutes: DataFrame, code: str = "activity") -> DataFrame:
    """The codes that occur, each checked to have six digits.

    The format is what bounds every table keyed by code: no data volume can produce more
    than a million of them, which keeps a broadcast of such a table safe. The check refers
    to the count, so it runs on the distinct codes and not on the rows of the fact.
    """
    counted = minutes.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("rows"))
    fails = F.raise_error(F.concat(F.lit("not a six-digit activity code: "), F.col(code)))
    known = F.when(F.col(code).rlike(CODE_FORMAT) | (F.col("rows") < 0), F.col(code)).otherwise(fails)
    return counted.select(known.alias(code))


def prefix_range(pattern: str) -> tuple[str, str] | None:
    """The texts from the first up to the second that begin with a pattern; None if it is more than a prefix.

    A prefix starts with a letter and can end with a range of digits, as in ``t010[2-9].*``.
    """
    found = re.fullmatch(r"([A-Za-z][A-Za-z0-9]*)(?:\[([0-9])-([0-9])\])?(?:\.\*)?", pattern)
    if found is None:
        return None
    stem, first, last = found.groups()
    if first is None:
        return stem, stem[:-1] + chr(ord(stem[-1]) + 1)
    return stem + first, stem + chr(ord(last) + 1)


def by_prefix(code: Column, patterns: Sequence[str], answer, otherwise: Column) -> Column | None:
    """``answer`` of the positions of all patterns that a code contains, found by a search among sorted bounds.

    The patterns' prefixes cut all codes into ranges with the same answer, between which a balanced tree of comparisons
    decides. A code that does not begin with the patterns' letter, or has it twice, is left to ``otherwise``, as a
    pattern may lie inside. None if a pattern is no prefix, or if their first letters differ.
    """
    ranges = [prefix_range(p) for p in patterns]
    letters = {p[:1] for p in patterns}
    if None in ranges or len(letters) != 1 or any(letters & set(p[1:]) for p in patterns):
        return None
    bounds: list[str] = []
    hits: list[tuple[int, ...]] = [()]
    for bound in sorted({b for r in ranges for b in r}):
        held = tuple(i for i, (low, high) in enumerate(ranges) if low <= bound < high)
        if held != hits[-1]:
            bounds.append(bound)
            hits.append(held)

    def between(first: int, last: int) -> Column:
        if first == last:
            return answer(hits[first])
        middle = (first + last) // 2
        return F.when(code < bounds[middle], between(first, middle)).otherwise(between(middle + 1, last))

    letter = letters.pop()
    plain = code.startswith(letter) & (F.locate(letter, code, 2) == 0)
    return F.when(plain, between(0, len(hits) - 1)).otherwise(otherwise)


def regex_left_join(
    codes: DataFrame, patterns: DataFrame | Sequence[tuple[str, str]], code: str = "activity"
) -> DataFrame:
    """Every pattern that a code contains; a code without a match keeps a NULL description.

    Pairs ``(pattern, description)`` are searched as prefixes where they are such, and tested one by one elsewhere. A
    DataFrame of patterns must be a fixed lookup, and ``codes`` a small table with one row per code: the match is then a
    theta join. Facts are labelled by a ``Labelling`` instead.
    """
    if isinstance(patterns, DataFrame):
        return codes.join(F.broadcast(patterns), F.expr(f"{code} rlike pattern"), "left")
    entries = [F.struct(F.lit(p).alias("pattern"), F.lit(d).alias("description")) for p, d in patterns]
    kind = "array<struct<pattern: string, description: string>>"
    tested = [F.when(F.col(code).rlike(p), entry) for (p, _), entry in zip(patterns, entries)]
    one_by_one = F.array_compact(F.array(*tested)).cast(kind)
    found = by_prefix(
        F.col(code), [p for p, _ in patterns], lambda hits: F.array(*[entries[i] for i in hits]).cast(kind), one_by_one
    )
    return codes.select("*", F.inline_outer(one_by_one if found is None else found))


def pattern_hit(code: Column, pattern: str) -> Column:
    """Whether a code contains the pattern; a plain prefix needs no regular expression."""
    literal = pattern.removesuffix(".*")
    return code.contains(literal) if literal.isalnum() else code.rlike(pattern)


@dataclass(frozen=True)
class Labelling:
    """A closed list of labels that code patterns give; the first matching pattern counts.

    The label is an expression over the code, so a fact is labelled while it is scanned: a search among the
    prefixes that the patterns are, and a test of one pattern after the other where they are no prefixes. With ``unmapped`` the codes no pattern matches form a label of their own, NULL.
    """

    patterns: tuple[tuple[str, str], ...] = lookups.CATEGORIES_V1
    unmapped: bool = True

    @property
    def labels(self) -> tuple[str | None, ...]:
        named = tuple(dict.fromkeys(d for _, d in self.patterns))
        return named + ((None,) if self.unmapped else ())

    def _first_match(self, code: Column, value, none: Column) -> Column:
        out = None
        for pattern, description in self.patterns:
            hit = pattern_hit(code, pattern)
            out = F.when(hit, value(description)) if out is None else out.when(hit, value(description))
        out = none if out is None else out.otherwise(none)
        first = lambda hits: value(self.patterns[hits[0]][1]) if hits else none
        found = by_prefix(code, [p for p, _ in self.patterns], first, out)
        return out if found is None else found

    def description(self, code: Column) -> Column:
        return self._first_match(code, F.lit, F.lit(None).cast("string"))

    def slot(self, code: Column) -> Column:
        """0-based position of the label; codes outside all labels have none."""
        labels = self.labels
        none = F.lit(labels.index(None) if self.unmapped else None).cast("int")
        return self._first_match(code, lambda d: F.lit(labels.index(d)), none)

    def among(self, code: Column, wanted: str) -> Column:
        """Whether the code's label contains a regular expression, case-sensitively.

        Prefixes are searched as for the label. Otherwise neighbouring patterns with the same answer form one
        alternation, so a filter tests a code against a few expressions and not against the whole list.
        """
        blocks = [
            (answer, "|".join(pattern for pattern, _ in run))
            for answer, run in groupby(self.patterns, lambda x: re.search(wanted, x[1]) is not None)
        ]
        if not blocks[-1][0]:
            blocks.pop()
        out = None
        for answer, pattern in blocks:
            hit = code.rlike(pattern)
            out = F.when(hit, answer) if out is None else out.when(hit, answer)
        out = F.lit(False) if out is None else out.otherwise(False)
        wants = [re.search(wanted, d) is not None for _, d in self.patterns]
        first = lambda hits: F.lit(bool(hits) and wants[hits[0]])
        found = by_prefix(code, [p for p, _ in self.patterns], first, out)
        return out if found is None else found


CURATED = Labelling(lookups.CATEGORIES_V1)
CURATED_V2 = Labelling(lookups.CATEGORIES_V2)
# category totals leave the data-quality codes and unknown codes out
WITHOUT_DATA_CODES = Labelling(
    tuple(x for x in lookups.CATEGORIES_V1 if x[0] != lookups.DATA_CODES_PATTERN), unmapped=False
)


def label_header(names: Iterable[str], patterns=lookups.CATEGORIES_V1) -> list[tuple[str, str | None]]:
    """The category of every column name, without touching any data."""
    rows = []
    for name in names:
        hits = [d for p, d in patterns if re.search(p, name)]
        rows.extend((name, d) for d in (hits or [None]))
    return rows


def unique_mapping(mapping: DataFrame) -> DataFrame:
    """A user's mapping with one row per six-digit code; a code listed twice is an error."""
    listed = (
        mapping.filter("activity is not null")
        .groupBy("activity")
        .agg(F.count(F.lit(1)).alias("rows"), F.first("description").alias("description"))
    )
    usable = F.col("activity").rlike(CODE_FORMAT) & (F.col("rows") == 1)
    fails = F.raise_error(F.concat(F.lit("not a six-digit code or listed twice: "), F.col("activity")))
    return listed.select(
        "activity", F.when(usable, F.col("description")).otherwise(fails).alias("description")
    )


# ---------------------------------------------------------------------------
# Code sets: small DataFrames with one column ``activity``
# ---------------------------------------------------------------------------


def codes_named(names: DataFrame, keyword: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Codes whose official name contains a keyword in any case."""
    kept = names.filter(F.col("description").rlike(f"(?i){keyword}"))
    for text in exclude:
        kept = kept.filter(F.col("description") != text)
    return kept.select(F.concat(F.lit("t"), F.col("code")).alias("activity"))


def keep_codes(minutes: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of the fact whose code is in a code set."""
    return minutes.join(F.broadcast(distinct_codes(codes)), "activity", "left_semi")


def without_nec(description: Column) -> Column:
    """False for the "not elsewhere classified" names; a missing name is kept."""
    return ~F.coalesce(description.rlike(r"n\.e\.c"), F.lit(False))


def code_catalogue(
    estimates: DataFrame, patterns: DataFrame | Sequence[tuple[str, str]], names: DataFrame, tier1: DataFrame
) -> DataFrame:
    """Code, official name, tier-1 name and category with the overall averages.

    ``estimates`` has one row per code that occurs.
    """
    specific = names.select(F.col("code"), F.col("description").alias("official_name"))
    summary = tier1.select(
        F.col("code").alias("tier1"), F.col("description").alias("official_summary_category")
    )
    return (
        regex_left_join(estimates, patterns)
        .withColumn("code", F.substring("activity", 2, 6))
        .withColumn("tier1", F.substring("code", 1, 2))
        .join(F.broadcast(summary), "tier1", "left")
        .join(F.broadcast(specific), "code", "left")
        .select(
            "code",
            "official_name",
            "official_summary_category",
            F.col("description").alias("suggested_categorization"),
            F.round("weighted_minutes", 2).alias("average_minutes"),
            F.round("minutes_per_participant", 2).alias("avg_minutes_per_participant"),
            F.round("participation_rate", 2).alias("participation_rate"),
        )
    )
