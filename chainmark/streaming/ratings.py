"""Elo ratings of a stream of results, in any order of arrival within the watermark.

Leagues are kept by themselves or some dozens together, as a message and a frame
cost as much as hundreds of games. The state is one value: a snapshot (ratings
after all games before the watermark) and the games since. A batch rates the list
anew from the snapshot, so a late game changes every later one of its league, and
gives out what has changed; games that the watermark has passed go into the
snapshot, in the batch or by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratings import ELO_HOME, ELO_K, ELO_MARGIN, _elo

_NAMES = ["league", "ms", "game", "season", "home", "away", "margin", "neutral"]
_ORDER = ["league", "ms", "game"]
RATED = "league string, game long, home_before double, away_before double, p_home double, home_after double, away_after double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class EloProcessor(StatefulProcessor):
    def __init__(self, k: float, home: float, factor: float, carry: float) -> None:
        self.settings = k, home, factor, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key: lists cost a message a game
        self.value = handle.getValueState("leagues", "snapshot string, games binary")

    def _rate(self, games: pd.DataFrame, known: dict) -> pd.DataFrame:
        """Rates games, which are in order, and leaves ratings and seasons in ``known``."""
        if not len(games):
            return pd.DataFrame()
        return _elo(games.assign(ts=games["ms"]), *self.settings, known).assign(ms=games["ms"].to_numpy())

    def _held(self) -> tuple[dict, int | None, pd.DataFrame]:
        """(ratings and season by league, timer, games since)."""
        value = self.value.get()
        if not value:
            return {}, None, pd.DataFrame(columns=_NAMES)
        snapshot = json.loads(value[0])
        known = {league: (dict(zip(teams, ratings, strict=True)), season) for league, season, teams, ratings in snapshot["leagues"]}
        with pa.ipc.open_stream(value[1]) as stream:
            return known, snapshot["timer"], stream.read_pandas()

    def _settle(self, known: dict, timer: int | None, games: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows of settled games, games that can still change); ``known`` takes in what is settled and is written."""
        old = games["ms"] < watermark
        rated, rest = self._rate(games[old], known), games[~old]
        last = int(rest["ms"].max()) + 1 if len(rest) else None
        if last is not None and last != timer:
            self.handle.registerTimer(last)
        leagues = [(league, None if season is None else int(season), list(rating), list(rating.values())) for league, (rating, season) in known.items()]
        table, sink = pa.Table.from_pandas(rest[_NAMES], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        self.value.update((json.dumps({"timer": last, "leagues": leagues}), sink.getvalue().to_pybytes()))
        return rated, rest

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[_NAMES]
        known, timer, held = self._held()
        # a result that is delivered again replaces itself
        games = (pd.concat([held, new], ignore_index=True) if len(held) else new).drop_duplicates(["league", "game"], keep="last").sort_values(_ORDER, kind="stable")
        first = new.sort_values(_ORDER, kind="stable").drop_duplicates("league")
        settled, rest = self._settle(known, timer, games, timerValues.getCurrentWatermarkInMs())
        both = pd.concat([x for x in (settled, self._rate(rest, known)) if len(x)])
        # what comes before a league's earliest new game stays as it was given out
        at = pd.Index(first["league"]).get_indexer(both["league"])
        ms, game = first["ms"].to_numpy()[at], first["game"].to_numpy()[at]
        changed = (at >= 0) & ((both["ms"] > ms) | ((both["ms"] == ms) & (both["game"] >= game)))
        yield both[changed.to_numpy()].drop(columns="ms")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._settle(*self._held(), timerValues.getCurrentWatermarkInMs())
        yield from ()  # what is settled was given out before

    def close(self) -> None:
        pass


def elo_stream(games: DataFrame, delay: str, k: float = ELO_K, home: float = ELO_HOME, factor: float = ELO_MARGIN, carry: float = 1 / 3, groups: int | None = None) -> DataFrame:
    """RATED rows of a stream of (league, game, ts timestamp, season, home, away, margin, neutral).

    In update mode; a game's newest row counts. Results later than ``delay``
    behind the newest are dropped by the watermark. With ``groups`` leagues are
    kept together in that many groups, the same for all runs of a stream; else
    each by itself. Needs the RocksDB state store, which is set for the session if it has no other provider that keeps
    state of several kinds.
    """
    spark = games.sparkSession
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    group = (F.col("league") if groups is None else F.pmod(F.xxhash64("league"), F.lit(groups)).cast("string")).alias("group")
    rows = games.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).select(group, "ts", *_NAMES)
    return rows.groupBy("group").transformWithStateInPandas(EloProcessor(k, home, factor, carry), RATED, "Update", "EventTime")
