"""Feature families: observations of plays and drives, and entity values knowable before a game.

Inputs are normalised plays (``normalise``), drives and games. Everything is
grouped sums and windows over (game, team) or (team, season); the only small
sides are rows of one per team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, plays
from . import ranges, windows
from .efficiency import ratio

# Thresholds, half-lives and weights of the families.
FINISHING_YARDS = 40
SHRINK_GAMES = 8
HALF_LIFE, LONG_HALF_LIFE = 6.5, 10.0
RECRUITING_WEIGHTS = (0.1, 0.2, 0.3, 0.4)
PASS_DEFAULT = 0.45
DISTANCE_BINS, MARGIN_BINS, CLOCK_BINS = (3, 6, 10), (-15, -8, -1, 0, 7, 14), (120, 300, 600)
POOL = "FCS_TIER"
PORTAL_SINCE = 2021


def normalise(raw: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Plays under one set of names, with class flags, success and garbage time.

    ``aliases`` maps each name to the input columns that may hold it; the first
    that is there and not null counts, and a name without any is null.
    """
    have = set(raw.columns)
    first = {n: [F.col(c) for c in of if c in have] for n, of in aliases.items()}
    rows = raw.select(*[(F.coalesce(*of) if of else F.lit(None).cast("double")).alias(n) for n, of in first.items()])
    label = F.col("play_type")
    flag, rule = plays.garbage_time(F.col("score_margin"), F.col("period"), F.col("wp_before"))
    flags = {"is_rush": plays.is_rush(label), "is_pass": plays.is_pass(label), "is_special_teams": plays.is_special(label), "is_penalty": plays.is_penalty(label), "is_havoc": plays.havoc(label), "is_success": plays.success(F.col("yards_gained"), F.col("distance"), F.col("down"))}
    return rows.withColumns(flags | {"garbage_time": flag, "gt_rule": rule, "gt_fallback_used": F.col("wp_before").isNull()})


def snaps(rows: DataFrame) -> DataFrame:
    """Rushes and passes outside garbage time."""
    return rows.where("not garbage_time and (is_rush or is_pass)")


def pool(team: Column, member: Column) -> Column:
    """The team, or one common key for all that are no members."""
    return F.when(member, team.cast("string")).otherwise(POOL)


def game_efficiency(rows: DataFrame) -> DataFrame:
    """(game_id, offense_id, defense_id) with five measures over all snaps, rushes and passes, in one aggregate."""

    def block(prefix: str, keep: Column) -> list[Column]:
        hit = keep & F.coalesce("is_success", F.lit(False))
        return [
            F.avg(F.when(keep, F.col("epa"))).alias(f"{prefix}epa_per_play"),
            F.avg(F.when(keep, F.col("is_success").cast("double"))).alias(f"{prefix}success_rate"),
            F.avg(F.when(hit, F.col("epa"))).alias(f"{prefix}explosiveness"),
            F.avg(F.when(keep, F.col("is_havoc").cast("double"))).alias(f"{prefix}havoc_rate"),
            F.count_if(keep).alias(f"{prefix}n_plays"),
        ]

    blocks = block("", F.lit(True)) + block("rush_", F.col("is_rush")) + block("pass_", F.col("is_pass"))
    return snaps(rows).where("offense_id is not null and defense_id is not null").groupBy("game_id", "offense_id", "defense_id").agg(*blocks)


def drive_metrics(drives: DataFrame) -> DataFrame:
    """(game_id, offense_id, finishing_drives, field_position): points of drives that start close, mean start."""
    close = F.col("start_yards_to_goal") <= FINISHING_YARDS
    return drives.groupBy("game_id", "offense_id").agg(F.avg(F.when(close, F.col("points"))).alias("finishing_drives"), F.avg(100 - F.col("start_yards_to_goal")).alias("field_position"))


def observations(rows: DataFrame, games: DataFrame, drives: DataFrame, members: DataFrame) -> DataFrame:
    """Efficiency of every (game, offense) with drives, home flag (never on neutral ground) and pooled opponents.

    ``games``: (game_id, home_id, neutral, event_time); ``members``: (team_id).
    """
    known = members.select("team_id").distinct()
    flag = lambda side: known.select(F.col("team_id").alias(side), F.lit(True).alias(f"{side}_member"))
    found = game_efficiency(rows).join(games, "game_id", "left").join(drive_metrics(drives), ["game_id", "offense_id"], "left")
    found = found.join(flag("offense_id"), "offense_id", "left").join(flag("defense_id"), "defense_id", "left")
    home = F.col("offense_id").eqNullSafe(F.col("home_id")) & ~F.coalesce("neutral", F.lit(False))
    sides = {s: pool(F.col(s), F.coalesce(f"{s}_member", F.lit(False))) for s in ("offense_id", "defense_id")}
    return found.withColumn("is_home", home).withColumns(sides).drop("offense_id_member", "defense_id_member")


def annotated(rows: DataFrame) -> DataFrame:
    """Adds elapsed_s and neutral_eligible: snaps whose clock says something about tempo."""
    w = Window.partitionBy("game_id", "drive_id").orderBy("period", "play_id")
    elapsed = plays.snap_elapsed(F.col("period"), F.lag("period").over(w), F.col("clock"), F.lag("clock").over(w))
    out = rows.where("not garbage_time").withColumn("elapsed_s", elapsed)
    aside = plays.kneel_or_spike(F.col("play_type")) | plays.end_of_half(F.col("period"), F.col("clock")) | (F.col("elapsed_s") < plays.HURRY_UP)
    return out.withColumn("neutral_eligible", F.coalesce((F.col("is_rush") | F.col("is_pass")) & ~aside & F.col("elapsed_s").isNotNull(), F.lit(False)))


def _bin(value: Column, edges: tuple[int, ...], closed: bool) -> Column:
    """How many edges lie below the value (or at it, if ``closed``)."""
    out = F.lit(0)
    for e in edges:
        out = out + ((value >= e) if closed else (value > e)).cast("int")
    return F.coalesce(out, F.lit(-1))


def tempo(rows: DataFrame) -> DataFrame:
    """(game_id, offense_id, defense_id): snaps, seconds between neutral snaps, pass rate and what exceeds expectation."""
    noted = annotated(rows)
    situation = [F.col("down"), _bin(F.col("distance"), DISTANCE_BINS, False), _bin(F.col("score_margin"), MARGIN_BINS, False), _bin(F.col("clock"), CLOCK_BINS, True), F.col("period")]
    keys = [f"s{i}" for i in range(5)]
    live = noted.where("is_rush or is_pass").withColumns(dict(zip(keys, situation, strict=True)))
    table = live.where("down >= 1").groupBy(*keys).agg(F.avg(F.col("is_pass").cast("double")).alias("expected"))
    both = live.join(table, keys, "left").withColumn("expected", F.coalesce("expected", F.lit(PASS_DEFAULT)))
    out = both.groupBy("game_id", "offense_id", "defense_id").agg(F.count("*").alias("plays_per_game"), F.avg(F.when(F.col("neutral_eligible"), F.col("elapsed_s"))).alias("sec_per_play"), F.avg(F.col("is_pass").cast("double")).alias("pass_rate"), F.avg(F.col("is_pass").cast("double") - F.col("expected")).alias("pass_rate_oe"))
    return out.withColumn("rush_rate_oe", -F.col("pass_rate_oe"))


def possessions(drives: DataFrame) -> DataFrame:
    return drives.where("game_id is not null").groupBy("game_id").agg(F.count("*").alias("possessions"))


def season_to_date(rows: DataFrame, team: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each (name, column), the mean over the team's earlier rows, and n_prior."""
    w = Window.partitionBy(team).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({n: F.avg(c).over(w) for n, c in values.items()} | {"n_prior": F.count("*").over(w)})


def entity_values(rows: DataFrame, entity: str, order: list[str], measures: dict[str, float], prior: float | Column = 0.0) -> DataFrame:
    """One row an entity: ``_std`` (mean shrunk to a prior), ``_ewma`` and ``_l3d`` of every measure.

    ``measures`` maps columns to half-lives, ``prior`` names no columns, the
    order must be total. Values are knowable at a time if ``rows`` ends before
    it. Each range part is summed as if nothing followed it; what does follow
    fades its weighted sum by a power, so no task holds an entity's rows.
    """
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    parts = ranges.ranged(rows.select(entity, *order, *[F.col(m).cast("double").alias(m) for m in measures]), [entity], order)
    back = Window.partitionBy(entity, ranges.PART).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    fade = {m: 1 - (1 - 0.5 ** (1 / half)) for m, half in measures.items()}
    # how many values of the part follow each one; one sort for all measures
    placed = ranges.dealt(parts).withColumns({f"{m}__k": F.when(F.col(m).isNotNull(), F.count(m).over(back) - 1) for m in measures})
    own = []
    for m in measures:
        k = F.col(f"{m}__k")
        own += [F.count(m).alias(f"{m}__n"), F.sum(m).alias(f"{m}__s"), F.sum(F.col(m) * F.pow(F.lit(fade[m]), k)).alias(f"{m}__e"), F.max_by(m, k).alias(f"{m}__first")]
        own += [F.max(F.when(k == i, F.col(m))).alias(f"{m}__{i}") for i in range(3)]
    later = Window.partitionBy(entity).orderBy(F.col(ranges.PART).desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row an entity and part
    sums = placed.groupBy(entity, ranges.PART).agg(*own)
    sums = sums.withColumns({f"{m}__after": F.coalesce(F.sum(f"{m}__n").over(later), F.lit(0)) for m in measures})
    aggregates = []
    for m in measures:
        after, n, mean = F.col(f"{m}__after"), F.sum(f"{m}__n"), F.try_divide(F.sum(f"{m}__s"), F.sum(f"{m}__n"))
        first = F.min_by(f"{m}__first", F.when(F.col(f"{m}__n") > 0, F.col(ranges.PART)))
        last = F.sum(sum(F.when(after + i < 3, F.coalesce(f"{m}__{i}", F.lit(0.0))).otherwise(0.0) for i in range(3)))
        # the first value weighs 1, all others 1 - fade
        ewma = (1 - fade[m]) * F.sum(F.col(f"{m}__e") * F.pow(F.lit(fade[m]), after)) + fade[m] * F.pow(F.lit(fade[m]), n - 1) * first
        aggregates += [numbers.shrunk(mean, n, prior, SHRINK_GAMES).alias(f"{m}_std"), ewma.alias(f"{m}_ewma"), (F.try_divide(last, F.least(n, F.lit(3))) - mean).alias(f"{m}_l3d")]
    return sums.groupBy(entity).agg(*aggregates)


def expected_possessions(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """(n, a, b1, b2): least squares of possessions on the sides' pace, from one aggregate."""
    from .inference import two_predictor_ols

    return two_predictor_ols(rows.withColumn("__one", F.lit(1)), ["__one"], y, x1, x2).drop("__one")


def situational(games: DataFrame, short_days: float = 6, bye_days: float = 13) -> DataFrame:
    """One row a game from (game_id, home_id, away_id, ts, rivalry): rest of both sides and rivalries around it.

    Sides are stacked, so one window a team gives the game before and after.
    """
    side = lambda name, team: games.select("game_id", "ts", "rivalry", F.lit(name).alias("side"), F.col(team).alias("team"))
    w = Window.partitionBy("team").orderBy("ts", "game_id")
    both = side("home", "home_id").unionByName(side("away", "away_id"))
    rest = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 86_400_000_000
    both = both.withColumns({"rest": rest, "post": F.coalesce(F.lag("rivalry").over(w), F.lit(False)), "ahead": F.coalesce(F.lead("rivalry").over(w), F.lit(False))})
    of = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    out = both.groupBy("game_id").agg(of("home", "rest").alias("rest_days_home"), of("away", "rest").alias("rest_days_away"), F.bool_or("post").alias("post_rivalry_flag"), F.bool_or("ahead").alias("rivalry_lookahead_flag"), F.bool_or("rivalry").alias("rivalry_flag"))
    least, most = F.least("rest_days_home", "rest_days_away"), F.greatest("rest_days_home", "rest_days_away")
    return out.withColumns({"rest_days_diff": F.col("rest_days_home") - F.col("rest_days_away"), "short_week_flag": F.coalesce(least < short_days, F.lit(False)), "bye_flag": F.coalesce(most >= bye_days, F.lit(False))})


def recruiting(rows: DataFrame, team: str = "team", season: str = "season", points: str = "points", weights: tuple[float, ...] = RECRUITING_WEIGHTS) -> DataFrame:
    """(team, season, composite): this class and those before it by weight, over the years that are there."""
    last = len(weights) - 1
    each = rows.where(F.col(points).isNotNull()).select(team, F.col(points).alias("__x"), F.col(season).alias("__s"), F.explode(F.array(*[F.struct(F.lit(last - i).alias("ahead"), F.lit(w).alias("w")) for i, w in enumerate(weights)])).alias("a"))
    near = each.select(team, (F.col("__s") + F.col("a.ahead")).alias(season), "__x", F.col("a.w").alias("w"))
    sums = near.groupBy(team, season).agg(ratio(F.sum(F.col("w") * F.col("__x")), F.sum("w")).alias("composite"))
    return rows.select(team, season).distinct().join(sums, [team, season], "left")


def portal_net(rows: DataFrame, since: int = PORTAL_SINCE) -> DataFrame:
    """(team, season, net): ratings that came less those that went, from (season, origin, destination, rating, ts).

    Moves count before the first of August; earlier seasons and untouched teams have none.
    """
    seen = rows.where((F.col("season") >= since) & (F.col("ts") < F.make_date("season", F.lit(8), F.lit(1)).cast("timestamp_ntz")))
    sides = F.array(F.struct(F.col("destination").alias("team"), F.col("rating").alias("x")), F.struct(F.col("origin").alias("team"), (-F.col("rating")).alias("x")))
    return seen.select("season", F.inline(sides)).where("team is not null").groupBy("team", "season").agg(F.sum("x").alias("net"))


def roster(rows: DataFrame, coach: str) -> DataFrame:
    """Adds tenure and change flag of a coach, and a null indicator for each nullable share, to (team, season) rows."""
    w = Window.partitionBy("team").orderBy("season")
    out = windows.tenures(rows, ["team"], coach, "season")
    before = F.lag(coach).over(w)
    return out.withColumn("change_flag", F.when(before.isNotNull(), before != F.col(coach))).withColumn("known_at", F.make_date("season", F.lit(8), F.lit(1)).cast("timestamp_ntz"))
