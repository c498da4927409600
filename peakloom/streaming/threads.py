"""Threads of messages as streams with state that ends: what each thread holds, its last messages, and a timer that closes it.

The state of a thread is one row of values (how many messages, the last of each column that isn't null, and where that stood), a list of its last
``most`` messages, and one timer in event time, set anew with every message to ``idle`` after the latest. When the watermark passes it, the thread is
given out as closed and its state is dropped; what comes for it later begins a new one. Messages of a batch may come in any order: later ones
by ``order`` win, whichever batch brings them. The state store is RocksDB, so state is on disk and need not fit an executor's memory.

Defined cases: a message without a time is counted and kept, and sets no timer; of messages with equal order the one that comes later wins; nulls in
the columns leave what the thread holds; messages that come later than the watermark are dropped, as by any stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Thread(StatefulProcessor):
    def __init__(self, thread: str, order: str, columns: list[str], message: str, most: int, idle_ms: int):
        self.thread, self.order, self.columns, self.message, self.most, self.idle_ms = thread, order, columns, message, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "turns long, latest long, columns string")
        self.last = handle.getListState("last", "place long, message string")

    def _row(self, key, turns: int, columns: dict, last: list, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], turns, *[columns[c][1] for c in self.columns], [m for _, m in last], closed]], columns=[self.thread, "turns", *self.columns, "recent", "closed"])

    def _state(self) -> tuple[int, int | None, dict]:
        if not self.held.exists():
            return 0, None, {c: [None, None] for c in self.columns}
        turns, latest, columns = self.held.get()
        return turns, latest, json.loads(columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, latest, columns = self._state()
        last = [(r[0], r[1]) for r in self.last.get()] if self.last.exists() else []
        for part in rows:
            turns += len(part)
            times = part["ms_"].dropna()
            if len(times):
                latest = max(int(times.max()), latest or 0)
            for place, message, *values in part[[self.order, self.message, *[f"held_{i}" for i in range(len(self.columns))]]].itertuples(index=False):
                last.append((int(place), None if pd.isna(message) else message))
                for c, value in zip(self.columns, values, strict=True):
                    if not pd.isna(value) and (columns[c][0] is None or place >= columns[c][0]):
                        columns[c] = [int(place), value]
            last = sorted(last, key=lambda x: x[0])[-self.most :]
        self.held.update((turns, latest, json.dumps(columns)))
        self.last.put(last)
        if latest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(latest + self.idle_ms)
        yield self._row(key, turns, columns, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns, _, columns = self._state()
        last = [(r[0], r[1]) for r in self.last.get()]
        self.held.clear()
        self.last.clear()
        yield self._row(key, turns, columns, last, True)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def threads(messages: DataFrame, thread: str, at: str, order: str, columns: list[str], message: str, most: int = 12, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(thread, turns, the columns, recent, closed) whenever a thread changes or ends; the thread's name is a number, the columns are text."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = messages.withColumn("at_", F.col(at).cast("timestamp")).withWatermark("at_", late)
    # Names with an underscore in front don't reach the processor.
    rows = rows.select(F.col(thread).cast("long").alias(thread), F.col(order).cast("long").alias(order), F.col(message).cast("string").alias(message), F.unix_millis("at_").alias("ms_"), *[F.col(c).cast("string").alias(f"held_{i}") for i, c in enumerate(columns)], "at_")
    schema = f"{thread} long, turns long, {', '.join(f'{c} string' for c in columns)}, recent array<string>, closed boolean"
    return rows.groupBy(thread).transformWithStateInPandas(_Thread(thread, order, columns, message, most, idle_ms), schema, "Update", "EventTime")
