"""Recodes, bins and text clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from daygrain import lookups

# fixed values: printed names of codes and metrics
SEX_LABELS = {1: "Male", 2: "Female"}
WORK_DAY_LABELS = {True: "Work day", False: "Leisure day"}
METRIC_LABELS = {
    "weighted_minutes": "Minutes",
    "participation_rate": "Participation rate",
    "minutes_per_participant": "Minutes per participant",
}


def recode(col: Column, mapping: dict) -> Column:
    """Replace listed values; anything else keeps its text."""
    out = None
    for value, label in mapping.items():
        out = F.when(col == F.lit(value), label) if out is None else out.when(col == F.lit(value), label)
    return out.otherwise(col.cast("string"))


def sex_label(col: Column) -> Column:
    return recode(col, SEX_LABELS)


def work_day_label(col: Column) -> Column:
    return recode(col, WORK_DAY_LABELS)


def metric_label(col: Column) -> Column:
    return recode(col, METRIC_LABELS)


def bin_rank(col: Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """Position of the right-closed bin ``(lo, hi]``; NULL outside the breaks."""
    out = None
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), 1):
        above = (col >= lo) if include_lowest and i == 1 else (col > lo)
        hit = above & (col <= hi)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.cast("int")


def bin_label(rank: Column, labels: Sequence[str]) -> Column:
    """Label of a bin position; a bin of NULL has no label."""
    return recode(rank, dict(enumerate(labels, 1)))


def race(code: Column) -> Column:
    # fixed values; a missing code also lands in the last branch
    return (
        F.when(code == 1, "white").when(code == 2, "black").when(code == 4, "asian").otherwise("other")
    )


def education(code: Column) -> Column:
    # fixed values; 38 and everything above 45 stay NULL
    return (
        F.when(code < 38, "Did not graduate from HS")
        .when(code == 39, "HS")
        .when(code.isin(40, 41, 42), "Some college")
        .when(code == 43, "Bachelors")
        .when(code == 44, "Masters")
        .when(code == 45, "Doctoral")
    )


def married(code: Column) -> Column:
    return (code == 1).cast("int")


def bracket_code(income_code: Column) -> Column:
    """Collapse the 16 income codes to the first code of the five wide brackets."""
    out = None
    for lo, hi, _ in lookups.INCOME_BRACKETS:
        hit = income_code.between(lo, hi)
        out = F.when(hit, lo) if out is None else out.when(hit, lo)
    return out.cast("int")


def missing_if(col: Column, value) -> Column:
    return F.when(col != F.lit(value), col)


def remove_first(col: Column, literal: str) -> Column:
    """Drop the first occurrence of a literal text; later ones stay."""
    return F.regexp_replace(col, rf"(?s)^(.*?)\Q{literal}\E", "$1")


def without_waiting_prefix(col: Column) -> Column:
    for prefix in lookups.WAITING_PREFIXES:
        col = remove_first(col, prefix)
    return col


def sentence_case(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1_000_000)))
