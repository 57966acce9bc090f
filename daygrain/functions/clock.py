"""Clock times, the 4 am diary day and printed durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
DAY_START = 240  # the diary day runs from 4 am to 4 am


def whole(minutes: Column, length: int) -> Column:
    """Integer division; stays off floating point."""
    return F.call_function("div", minutes, F.lit(length)).cast("int")


def minute_of_day(clock: Column) -> Column:
    """``HH:mm:ss`` text to minutes after midnight."""
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def floor_to(minutes: Column, step: int) -> Column:
    return minutes if step == 1 else minutes - minutes % step


def since_day_start(minutes: Column) -> Column:
    """Minutes after midnight to minutes after 4 am."""
    return F.pmod(minutes - F.lit(DAY_START), F.lit(DAY)).cast("int")


def cap_wrapped(start: Column, end: Column, cap: int) -> Column:
    """A spell that runs past 4 am ends at ``cap``."""
    return F.when(end < start, F.lit(cap)).otherwise(end).cast("int")


def _hours_minutes(minutes: Column, rounded: bool) -> tuple[Column, Column]:
    hours = F.floor(minutes / 60)
    rest = minutes - hours * 60
    # halves go up, as the printed tables do
    return hours.cast("int"), (F.floor(rest + 0.5) if rounded else F.floor(rest)).cast("int")


def hours_minutes_truncated(minutes: Column) -> Column:
    """``75.9`` to `` 1:15``: width-two hours, seconds cut off."""
    return F.format_string("%2d:%02d", *_hours_minutes(minutes, rounded=False))


def hours_minutes_rounded(minutes: Column) -> Column:
    """``75.9`` to ``1:16``. A remainder of 59.5 or more prints as ``:60``."""
    return F.format_string("%d:%02d", *_hours_minutes(minutes, rounded=True))


def duration_in_words(minutes: Column) -> Column:
    """``75`` to ``1 hour, 15 minutes``."""
    hours, rest = _hours_minutes(minutes, rounded=True)
    tail = F.concat(rest.cast("string"), F.lit(" minutes"))
    return (
        F.when(hours == 0, tail)
        .when(hours == 1, F.concat(F.lit("1 hour, "), tail))
        .otherwise(F.concat(hours.cast("string"), F.lit(" hours, "), tail))
    )
