"""Season calendar, decision instants and clock arithmetic as column expressions.

Timestamps without a zone are taken as UTC wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def season_of(day: Column) -> Column:
    """The year, or the year before for January games."""
    return F.year(day) - (F.month(day) == 1).cast("int")


def labor_day(season: Column) -> Column:
    """First Monday of September."""
    return F.next_day(F.make_date(season, F.lit(8), F.lit(31)), "Mon")


def week_of(day: Column, season: Column) -> Column:
    """Weeks since the season's Labor Day week, 1 for that week, never below 0."""
    days = F.date_diff(F.to_date(day), labor_day(season))
    return F.greatest(F.lit(0), F.floor(days / 7).cast("int") + 1)


def local_to_utc(wall: Column, zone: str | Column = ZONE) -> Column:
    return F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), wall)


def utc_to_local(ts: Column, zone: str | Column = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), ts)


def offset_hours(ts: Column, zone: str | Column) -> Column:
    """Hours between a zone's wall clock and UTC at an instant."""
    return F.timestamp_diff("MINUTE", ts, utc_to_local(ts, zone)) / 60


def decision_instants(kickoff: Column, weekday_hours: tuple[tuple[int, int], ...] = ((1, 6), (5, 6))) -> Column:
    """UTC instants of each (days after Monday, local hour) in the kickoff's local week."""
    monday = F.date_trunc("week", utc_to_local(kickoff)).cast("timestamp_ntz")
    shift = lambda d, h: local_to_utc(monday + F.make_dt_interval(F.lit(d), F.lit(h)))
    return F.array(*[shift(d, h) for d, h in weekday_hours])


def slot_close(kickoff: Column, minutes: int = 5) -> Column:
    """The last decision instant of a game: ``minutes`` before kickoff."""
    return kickoff - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def feature_as_of(kickoff: Column, week_decision: Column, candidates: Column) -> Column:
    """The week's decision where it lies strictly before kickoff, else the latest candidate that does, else null."""
    return F.when(week_decision < kickoff, week_decision).otherwise(F.array_max(F.filter(candidates, lambda c: c < kickoff)))


def tolerance_minutes(at: Column, changed: str = "2022-09-01", before: int = 10, after: int = 5) -> Column:
    """Minutes that a snapshot may be old at a decision: intervals were longer before ``changed``. The date and both lengths."""
    return F.when(at < F.lit(changed).cast("timestamp_ntz"), before).otherwise(after)
