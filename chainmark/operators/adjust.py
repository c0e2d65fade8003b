"""Opponent adjustment of any number of entities by conjugate gradients.

y = off(offense) - def(defense) + hfa * home, ridge on every coefficient, for all
groups (dates, measures) at once. The normal equations are never formed: one
pass sums games by pair of entities, and an iteration multiplies that pair table
with the current directions (two joins and a sum) and updates vectors that are
tables of (group, side, entity). A group's step sizes come from four sums, so an
iteration writes one table; the driver sees one number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept
from . import features

PENALTY = 5.0
#: Relative residual at which a group is solved, and the most iterations.
ENOUGH, MOST = 1e-10, 200
#: Rows of a task that puts measures side by side, about.
ROWS = 1_000_000
SIDES, FORMS = ("off", "def"), ("std", "ewma", "l3d")
# The adjusted metrics by name and the columns they come from.
METRICS = {
    "epa": "epa_per_play", "rush_epa": "rush_epa_per_play", "pass_epa": "pass_epa_per_play", "success_rate": "success_rate", "rush_success_rate": "rush_success_rate", "pass_success_rate": "pass_success_rate",
    "explosiveness": "explosiveness", "rush_explosiveness": "rush_explosiveness", "pass_explosiveness": "pass_explosiveness", "havoc": "havoc_rate", "finishing_drives": "finishing_drives", "field_position": "field_position",
}
TEMPO = {m: m for m in ("plays_per_game", "sec_per_play", "pass_rate_oe", "rush_rate_oe")}


def feature_name(side: str, metric: str, form: str) -> str:
    return f"adj_{side}_{metric}_{form}"


def parse_feature(name: str, metrics: dict[str, str] = METRICS) -> tuple[str, str, str]:
    """(side, metric, form) of a feature's name; other names are refused."""
    found = re.fullmatch(rf"adj_({'|'.join(SIDES)})_({'|'.join(sorted(metrics, key=len, reverse=True))})_({'|'.join(FORMS)})", name)
    if not found:
        raise ValueError(f"{name!r} is no adjusted feature")
    return found.groups()


def observations(games: DataFrame, keep: list[str], metrics: dict[str, str]) -> DataFrame:
    """(keep, measure, y): a row a game, side and measure that is there."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("y")) for m, c in metrics.items()])
    return games.select(*keep, F.inline(each)).where("y is not null")


def _same(a: str, b: str, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def solve(rows: DataFrame, by: list[str], offense: str, defense: str, home: str, y: str, penalty: float = PENALTY) -> DataFrame:
    """(by, side, entity, value): off, def and, with a null entity, home of every group; rows without entities or y are left out."""
    games = rows.select(*by, F.col(offense).cast("string").alias("o"), F.col(defense).cast("string").alias("d"), F.coalesce(F.col(home).cast("double"), F.lit(0.0)).alias("h"), F.col(y).cast("double").alias("y")).where("o is not null and d is not null and y is not null")
    sums = {"n": F.lit(1.0), "sy": F.col("y"), "sh": F.col("h"), "shh": F.col("h") * F.col("h"), "shy": F.col("h") * F.col("y")}
    pairs = kept(games.groupBy(*by, "o", "d").agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "pairs")

    def spread(df: DataFrame, off: Column, def_: Column, home_: Column, names: list[str]) -> DataFrame:
        """Sums by unknown of what each pair adds to its two entities and to home."""
        own = lambda side, entity, value: F.struct(F.lit(side).alias("side"), entity.alias("entity"), *[v.alias(n) for v, n in zip(value, names, strict=True)])
        each = F.inline(F.array(own("off", F.col("o"), off), own("def", F.col("d"), def_), own("home", F.lit(None).cast("string"), home_)))
        return df.select(*by, each).groupBy(*by, "side", "entity").agg(*[F.sum(n).alias(n) for n in names])

    start = spread(pairs, [F.col("sy"), F.col("n")], [-F.col("sy"), F.col("n")], [F.col("shy"), F.col("shh")], ["r", "g"])
    g = F.col("g") + penalty
    # x = 0: residuals are the right sides; directions are residuals over the diagonal
    now = start.select(*by, "side", "entity", F.lit(0.0).alias("x"), "r", g.alias("g"), (F.col("r") / g).alias("p"))
    first = None
    unknown = [*by, "side", "entity"]
    for _ in range(MOST):
        p = now.select(*unknown, "p")
        side = lambda s, name: p.where(F.col("side") == s).select(*by, F.col("entity").alias(f"e_{name}"), F.col("p").alias(name)).alias(s)
        met = pairs.alias("t").join(side("off", "po"), _same("t", "off", by) & (F.col("t.o") == F.col("e_po"))).join(side("def", "pd"), _same("t", "def", by) & (F.col("t.d") == F.col("e_pd")))
        met = met.join(side("home", "ph"), _same("t", "home", by)).select(*[F.col(f"t.{c}").alias(c) for c in by], "o", "d", "n", "sh", "shh", "po", "pd", "ph")
        flow = F.col("n") * (F.col("po") - F.col("pd")) + F.col("sh") * F.col("ph")
        q = spread(met, [flow], [-flow], [F.col("sh") * (F.col("po") - F.col("pd")) + F.col("shh") * F.col("ph")], ["q"])
        step = now.alias("a").join(q.alias("b"), _same("a", "b", unknown)).select(*[F.col(f"a.{c}").alias(c) for c in unknown], "x", "r", "g", "p", (F.col("q") + penalty * F.col("p")).alias("q"))
        step = kept(step, "gradients")
        r, q_, g_ = F.col("r"), F.col("q"), F.col("g")
        four = step.groupBy(*by).agg(F.sum(r * r / g_).alias("rr"), F.sum(r * q_ / g_).alias("rq"), F.sum(q_ * q_ / g_).alias("qq"), F.sum(F.col("p") * q_).alias("pq"))
        a = F.coalesce(F.try_divide(F.col("rr"), F.col("pq")), F.lit(0.0))
        left = F.greatest(F.lit(0.0), F.col("rr") - 2 * a * F.col("rq") + a * a * F.col("qq"))
        scalars = kept(four.select(*by, "rr", a.alias("a"), F.coalesce(F.try_divide(left, F.col("rr")), F.lit(0.0)).alias("b")), "steps")
        first = scalars.select(*by, F.col("rr").alias("rr0")) if first is None else first
        both = step.alias("a").join(scalars.alias("b"), _same("a", "b", by)).select(*[F.col(f"a.{c}").alias(c) for c in unknown], F.col("a.x"), F.col("a.r"), F.col("a.g"), F.col("a.p"), F.col("a.q"), F.col("b.a").alias("s"), F.col("b.b").alias("t"))
        rest = F.col("r") - F.col("s") * F.col("q")
        now = both.select(*unknown, (F.col("x") + F.col("s") * F.col("p")).alias("x"), rest.alias("r"), "g", (rest / F.col("g") + F.col("t") * F.col("p")).alias("p"))
        open_ = scalars.alias("a").join(first.alias("b"), _same("a", "b", by)).where(F.col("a.rr") * F.col("a.b") > ENOUGH**2 * F.col("b.rr0"))
        if not open_.head(1):
            break
    return now.select(*unknown, F.col("x").alias("value"))


def residuals(rows: DataFrame, by: list[str], offense: str, defense: str, home: str, y: str, found: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """(by, side, entity, n, residual) of the normal equations, from the rows themselves; zero where solved."""
    games = adjusted(rows, by, offense, defense, home, y, found).where(F.col("__fit").isNotNull())
    e, h = F.col(y) - F.col("__fit"), F.coalesce(F.col(home).cast("double"), F.lit(0.0))
    own = lambda side, entity, v: F.struct(F.lit(side).alias("side"), entity.cast("string").alias("entity"), v.alias("e"))
    each = games.select(*by, F.inline(F.array(own("off", F.col(offense), e), own("def", F.col(defense), -e), own("home", F.lit(None), h * e))))
    sums = each.groupBy(*by, "side", "entity").agg(F.count("*").alias("n"), F.sum("e").alias("s"))
    unknown = [*by, "side", "entity"]
    met = sums.alias("a").join(found.alias("b"), _same("a", "b", unknown))
    return met.select(*[F.col(f"a.{c}").alias(c) for c in unknown], "n", (F.col("s") - penalty * F.col("value")).alias("residual"))


def adjusted(rows: DataFrame, by: list[str], offense: str, defense: str, home: str, y: str, found: DataFrame) -> DataFrame:
    """Adds adj_off and adj_def, each row's value freed of the opponent and the venue, and __fit."""
    side = lambda s: found.where(F.col("side") == s).alias(s)
    met = rows.alias("t").join(side("off"), _same("t", "off", by) & (F.col(f"t.{offense}").cast("string") == F.col("off.entity")), "left")
    met = met.join(side("def"), _same("t", "def", by) & (F.col(f"t.{defense}").cast("string") == F.col("def.entity")), "left").join(side("home"), _same("t", "home", by), "left")
    edge = F.col("home.value") * F.coalesce(F.col(f"t.{home}").cast("double"), F.lit(0.0))
    value = F.col(f"t.{y}")
    return met.select("t.*", (value + F.col("def.value") - edge).alias("adj_off"), (F.col("off.value") - value + edge).alias("adj_def"), (F.col("off.value") - F.col("def.value") + edge).alias("__fit"))


def family(obs: DataFrame, offense: str, defense: str, home: str, order: list[str], metrics: dict[str, str], half_life: float = 4.0) -> DataFrame:
    """(entity, adj_{side}_{metric}_{form}): all adjusted features of the rows given.

    ``obs`` is as from ``observations``; a date's features are knowable if it
    ends before that date.
    """
    found = kept(solve(obs, ["measure"], offense, defense, home, "y"), "solved")
    games = kept(adjusted(obs, ["measure"], offense, defense, home, "y", found), "adjusted")
    # more rows make more tasks, so that what a task sums up stays as it is
    tasks = max(int(games.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-games.count() // ROWS))
    out = None
    for side, entity in (("off", offense), ("def", defense)):
        own = games.select(F.col(entity).cast("string").alias("entity"), *order, "measure", f"adj_{side}").repartition(tasks, "entity", *order)
        wide = own.groupBy("entity", *order).pivot("measure", list(metrics)).agg(F.first(f"adj_{side}"))
        values = features.entity_values(wide, "entity", order, dict.fromkeys(metrics, half_life))
        named = values.select("entity", *[F.col(f"{m}_{f}").alias(feature_name(side, m, f)) for m in metrics for f in FORMS])
        out = named if out is None else out.join(named, "entity", "full")
    return out
