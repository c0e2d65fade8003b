"""Play classification as column expressions: (columns of) staged plays in, flags out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Play labels by class, garbage-time limits by quarter (overtime counts as the fourth), success shares by down.
RUSH = ("Rush", "Rushing Touchdown")
PASS = ("Pass Reception", "Pass Incompletion", "Passing Touchdown", "Sack", "Interception", "Interception Return Touchdown", "Pass Interception Return")
SPECIAL = (
    "Kickoff",
    "Kickoff Return (Offense)",
    "Kickoff Return Touchdown",
    "Punt",
    "Punt Return Touchdown",
    "Blocked Punt",
    "Blocked Punt Touchdown",
    "Field Goal Good",
    "Field Goal Missed",
    "Blocked Field Goal",
    "Blocked Field Goal Touchdown",
    "Missed Field Goal Return",
    "Missed Field Goal Return Touchdown",
    "Safety",
)
PENALTY = ("Penalty",)
HAVOC = ("Sack", "Interception", "Interception Return Touchdown", "Pass Interception Return", "Fumble Recovery (Opponent)", "Fumble Return Touchdown")
MARGIN_LIMITS = {1: 28, 2: 24, 3: 21, 4: 16}
SUCCESS_SHARE = {1: 0.5, 2: 0.7, 3: 1.0, 4: 1.0}
WP_LOW, WP_HIGH = 0.02, 0.98
HALF_END, HURRY_UP, QUARTER = 120, 12, 900
RULE_WP, RULE_MARGIN = "wp", "connelly_fallback"


def _by(key: Column, values: dict[int, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def garbage_time(margin: Column, period: Column, wp: Column) -> tuple[Column, Column]:
    """(flag, rule): by win probability where it is known, else by margin and quarter."""
    limit = F.coalesce(_by(F.least(period, F.lit(4)), MARGIN_LIMITS), F.lit(MARGIN_LIMITS[4]))
    by_wp, by_margin = (wp > WP_HIGH) | (wp < WP_LOW), (F.abs(margin) > limit) & period.isNotNull()
    return F.when(wp.isNotNull(), by_wp).otherwise(F.coalesce(by_margin, F.lit(False))), F.when(wp.isNotNull(), RULE_WP).otherwise(RULE_MARGIN)


def success(yards: Column, distance: Column, down: Column) -> Column:
    """Whether a play gained its down's share of the distance; null where a part is missing or the down is not 1 to 4."""
    return yards >= distance * _by(down, SUCCESS_SHARE)


def _in(label: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(label.isin(*names), F.lit(False))


def is_rush(label: Column) -> Column:
    return _in(label, RUSH)


def is_pass(label: Column) -> Column:
    return _in(label, PASS)


def is_special(label: Column) -> Column:
    return _in(label, SPECIAL)


def is_penalty(label: Column) -> Column:
    return _in(label, PENALTY)


def havoc(label: Column) -> Column:
    return _in(label, HAVOC)


def kneel_or_spike(label: Column) -> Column:
    return F.coalesce(label.rlike("(?i)kneel|spike"), F.lit(False))


def end_of_half(period: Column, clock: Column) -> Column:
    return F.coalesce(period.isin(2, 4) & (clock <= HALF_END), F.lit(False))


def snap_elapsed(period: Column, before_period: Column, clock: Column, before_clock: Column) -> Column:
    """Seconds between snaps, over one quarter's end at most; within (0, 960], else null."""
    seconds = F.when(period == before_period, before_clock - clock).when(period == before_period + 1, before_clock + QUARTER - clock)
    return F.when((seconds > 0) & (seconds <= QUARTER + 60), seconds)
