"""A translation cache as streaming state, by event time.

Rows (key, value, at) with a ``value`` store it, rows without one ask for it.  Rows wait in the state until the
watermark has passed them and are then taken in order of time, a store before a request of the same moment (of
stores at one moment the largest value counts).  So the answers depend on the rows' own times only, not on files,
batches or their order, as long as rows are not later than ``delay``.  A value leaves the state when it expires.
Requests without a time find nothing and wait for nothing; stores without one are not read.

Waiting is Spark's own aggregation by key and moment, so a key with very many rows waits in many tasks.  What the
watermark has passed goes on to the living values, which are kept by slots of keys: a task is called, and reads its
state, once for all of a slot's rows in a batch, not once for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.fixed_values import CACHE_TTL_DAYS

OUTPUT = "key string, value string, cached_at timestamp, asked_at timestamp, hit boolean, times long"
_ROW = "value string, since long"
_DAY = 86_400_000_000   # microseconds
_TTL = CACHE_TTL_DAYS * _DAY
ROWS_OUT = 4096
SLOTS = 1024
READ_ALL = 50   # reading so many values in a row costs about as much as asking for one
# timers need a state store that keeps them apart from the values
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _moments(micros: list[int | None]) -> pd.Series:
    return pd.Series(pd.array(micros, "Int64").to_numpy("datetime64[us]", na_value=np.datetime64("NaT")))


def _late(since: int) -> int:
    """The millisecond at which a value is removed at the latest: a day's values go together."""
    return -(-(since + _TTL) // _DAY) * _DAY // 1000 + 1


class CacheKeeper(StatefulProcessor):
    """Per slot of keys: each key's newest value among the rows that the watermark has passed, while it is alive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", "known boolean, key string", _ROW)
        self._size = handle.getValueState("size", "n long, timer long")

    def _values_of(self, keys: list[tuple], size: int) -> dict[tuple, tuple]:
        """What the state holds of the keys, read in one go unless that is far more than was asked for."""
        if size > READ_ALL * len(keys):
            found = {key: self._held.getValue(key) for key in keys}
            return {key: row for key, row in found.items() if row is not None}
        asked = set(keys)
        return {key: row for key, row in ((tuple(k), tuple(v)) for k, v in self._held.iterator()) if key in asked} if size else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """``rows``: the passed moments of keys, each with its store if there is one and the number of requests."""
        moments: dict[tuple, list[tuple]] = {}
        for batch in rows:
            at = batch["at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for name, *moment in zip(batch["key"], at, batch["stored"], batch["asks"].tolist(), strict=True):
                known = isinstance(name, str)
                moments.setdefault((known, name if known else ""), []).append(moment)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        size, timer = self._size.get() or (0, None)
        before = size, timer
        held, found = self._values_of(list(moments), size), []
        for key, some in moments.items():
            value, since = old = held.get(key, (None, None))
            for at, stored, asks in sorted(some, key=lambda m: m[0]):
                if isinstance(stored, str):
                    value, since = stored, at
                if asks:
                    hit = value is not None and at - since < _TTL
                    found.append((key[1] if key[0] else None, value if hit else None, since if hit else None, at, hit, asks))
            if since != old[1] and passed - since < _TTL:   # an expired one is left to the timer
                self._held.updateValue(key, (value, since))
                size += key not in held
                if timer is None or _late(since) < timer:
                    timer = _late(since)
                    self._handle.registerTimer(timer)
        if (size, timer) != before:
            self._size.update((size, timer))
        for k in range(0, len(found), ROWS_OUT):
            keys, values, stored_at, asked_at, hits, times = zip(*found[k:k + ROWS_OUT], strict=True)
            yield pd.DataFrame({
                "key": pd.Series(keys, dtype=object), "value": pd.Series(values, dtype=object),
                "cached_at": _moments(stored_at), "asked_at": _moments(asked_at), "hit": hits, "times": times,
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        alive, gone = [], []
        for key, row in self._held.iterator():
            if passed - row[1] < _TTL:
                alive.append(row[1])
            else:
                gone.append(tuple(key))
        if not alive:
            self._held.clear()
            self._size.clear()
            return iter(())
        for key in gone:
            self._held.removeKey(key)
        timer = max(_late(min(alive)), passed // 1000 + 1)
        self._handle.registerTimer(timer)
        self._size.update((len(alive), timer))
        return iter(())

    def close(self) -> None:
        pass


def stream_cache(requests: DataFrame, delay: str = "0 seconds", slots: int = SLOTS) -> DataFrame:
    """Answers to the (key, value, at) rows of a stream that have no value; rows later than ``delay`` are not read.

    ``slots`` is fixed with the first batch; no more tasks than that work on the living values.
    """
    moments = requests.withWatermark("at", delay).groupBy("key", "at").agg(
        F.max("value").alias("stored"), F.count_if(F.col("value").isNull()).alias("asks")
    )
    slotted = moments.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)))
    answers = slotted.groupBy("slot").transformWithStateInPandas(CacheKeeper(), OUTPUT, "Append", "EventTime")
    # equal requests were folded together while they waited
    answers = answers.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_each", "times")
    timeless = requests.where(F.col("at").isNull() & F.col("value").isNull()).select(
        F.col("key").cast("string"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp").alias("cached_at"),
        F.lit(None).cast("timestamp").alias("asked_at"), F.lit(False).alias("hit"),
    )
    return answers.unionByName(timeless)


def answer_available(requests: DataFrame, path: str, progress: str, delay: str = "0 seconds"):
    """Answer all input that the watermark passes and stop; answers are appended to ``path``."""
    spark = requests.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STORE)
    try:
        return (
            stream_cache(requests, delay).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(setting, before)
