"""Runs that are watched until they settle: announced once, given up after a while, forgotten later."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds after which a run that does not settle is given up, and for which an announced one is remembered.
GIVE_UP_S, REMEMBER_S = 5_400, 3_600
ANNOUNCED = "run string, at timestamp, kind string, text string"
STATE = "since long, told boolean, text string"


class Watcher(StatefulProcessor):
    """Keeps for each run when it was first seen, whether it was announced, and what was last heard of it.

    A first settled row announces the run; so does the timer of ``give_up_s`` for a run that never settles, as ``stale``.
    From then on the run is silent, until the timer of ``remember_s`` takes its state away.
    """

    def __init__(self, give_up_s: int, remember_s: int):
        self.give_up, self.remember = give_up_s * 1000, remember_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def _tell(self, key: str, at: int, kind: str, since: int, text: str | None) -> pd.DataFrame:
        self.run.update((since, True, text))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.remember)
        return pd.DataFrame({"run": [key], "at": [pd.Timestamp(at, unit="ms")], "kind": [kind], "text": [text]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heard = pd.concat(list(rows)).sort_values(["at", "settled"], kind="stable")
        for at, settled, text in zip(heard["at"], heard["settled"], heard["text"], strict=True):
            ms = int(at.value // 1_000_000)
            if not self.run.exists():
                self.run.update((ms, False, text))
                self.handle.registerTimer(ms + self.give_up)
            since, told, _ = self.run.get()
            if told:
                continue
            if settled:
                yield self._tell(key[0], ms, "settled", since, text)
            else:
                self.run.update((since, False, text))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            since, told, text = self.run.get()
            if told:
                self.run.clear()
            else:
                yield self._tell(key[0], since + self.give_up, "stale", since, text)

    def close(self) -> None:
        pass


def announcements(stream: DataFrame, late: str = "0 seconds", give_up_s: int = GIVE_UP_S, remember_s: int = REMEMBER_S) -> DataFrame:
    """Each run's one announcement (run, at, kind settled or stale, text) from rows (run, at, settled, text) about runs to be announced.

    Times are the rows' own; timers fire as the watermark, ``late`` behind, passes them. The state is kept in RocksDB,
    whose provider the session must name.
    """
    rows = stream.select(F.col("run").cast("string"), F.col("at").cast("timestamp"), F.coalesce("settled", F.lit(False)).alias("settled"), F.col("text").cast("string")).where("run is not null and at is not null")
    return rows.withWatermark("at", late).groupBy("run").transformWithStateInPandas(Watcher(give_up_s, remember_s), ANNOUNCED, "Append", "EventTime")
