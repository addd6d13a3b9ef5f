"""Handles with a time to live: made, used once, given up, or expired.

``answers`` is the stream, one state value and one timer a handle; ``replayed`` gives the same answers for a
whole table by windows. Times are event times; requests of one time go in the order of ``request_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds that a handle lives, its requests, and the answers.
TTL_S = 120
PREPARE, USE, RELEASE = "prepare", "use", "release"
PREPARED, OK, RELEASED, EXPIRED = "prepared", "ok", "released", "expired_handle"

ANSWER = "handle string, request_id long, ts timestamp, answer string"
#: What a session needs to run ``answers``.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Handles(StatefulProcessor):
    """The state of a handle is the millisecond at which it expires; a timer at that time clears it."""

    def __init__(self, ttl_s: float):
        self.ttl_ms = int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "ms long")

    def _drop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.expires.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        alive = self.expires.get()[0] if self.expires.exists() else None
        given = []
        for ts, kind in zip(asked["ts"], asked["kind"]):
            now = ts.value // 1_000_000
            good = alive is not None and now < alive
            given.append({PREPARE: PREPARED, RELEASE: RELEASED}.get(kind, OK if good else EXPIRED))
            alive = now + self.ttl_ms if kind == PREPARE else None
        self._drop()
        if alive is not None and alive > timers.getCurrentWatermarkInMs():
            self.expires.update((alive,))
            self.handle.registerTimer(alive)
        yield pd.DataFrame({"handle": key[0], "request_id": asked["request_id"], "ts": asked["ts"], "answer": given})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.expires.clear()
        yield pd.DataFrame({"handle": pd.Series(dtype=str), "request_id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[ns]"), "answer": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def answers(requests: DataFrame, ttl_s: float = TTL_S, late: str = "10 seconds") -> DataFrame:
    """What each request of a stream is told: a use finds its handle once, within ``ttl_s`` of its making.

    requests: handle string, request_id long, ts timestamp, kind. Needs ``STATE_STORE``. A handle whose time is over is
    forgotten when the watermark passes it, asked for or not. A key's requests of one micro-batch are held together.
    """
    asked = requests.select("handle", "request_id", "ts", "kind").withWatermark("ts", late)
    return asked.groupBy("handle").transformWithStateInPandas(_Handles(ttl_s), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


def replayed(requests: DataFrame, ttl_s: float = TTL_S) -> DataFrame:
    """``answers`` for a whole table; a use is answered by the request just before it. Rows with a null handle, kind
    or time are left out, of handles that were never made all uses are expired."""
    asked = requests.select("handle", "request_id", "ts", "kind").dropna()
    before = Window.partitionBy("handle").orderBy("ts", "request_id")
    last = F.lag(F.struct("kind", "ts")).over(before)
    lives = (F.col("_last.kind") == PREPARE) & (F.unix_millis("ts") < F.unix_millis("_last.ts") + F.lit(int(ttl_s * 1000)))
    answer = F.when(F.col("kind") == PREPARE, PREPARED).when(F.col("kind") == RELEASE, RELEASED).when(lives, OK).otherwise(EXPIRED)
    return asked.withColumn("_last", last).select("handle", "request_id", "ts", answer.alias("answer"))
