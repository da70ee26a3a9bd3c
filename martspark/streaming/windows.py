"""Windowed service metrics and the rate limit as running queries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from martspark.operators.ratelimit import RATE_LIMIT, RATE_WINDOW_SECONDS, decide


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all available input into Parquet."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.outputMode("append").format("parquet").option("path", path).start()


def run_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregation in update mode: a folder per micro-batch holds the groups it changed."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.outputMode("update").foreachBatch(keep).start()


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The latest state of every group from what ``run_updates`` left."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    measures = [f.name for f in schema.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*measures), "batch").alias("m"))
    return last.select(*keys, *(F.col(f"m.{name}").alias(name) for name in measures))


class RateLimiter(StatefulProcessor):
    """Decides a client's requests in the order of their times, once the watermark has passed them.

    State of a client: requests that wait for the watermark, and at most ``limit`` accepted
    times. Every call to the state goes to the JVM and back, so requests lie there in columns, an element
    for those that came together. A timer stands at the earliest waiting request; when nothing waits it stands
    where the newest accepted time leaves the window and then clears the client.
    """

    def __init__(self, fields: T.StructType, limit: int, window_us: int):
        self.fields, self.limit, self.window_us = fields, limit, window_us
        self.names = [f.name for f in fields.fields if f.name != "ts"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = [T.StructField("us", T.ArrayType(T.LongType()))]
        waiting += [T.StructField(name, T.ArrayType(self.fields[name].dataType)) for name in self.names]
        self.waiting = handle.getListState("waiting", T.StructType(waiting))
        self.accepted = handle.getListState("accepted", T.StructType([T.StructField("us", T.LongType())]))

    def _wake(self, us: int, watermark_ms: int) -> None:
        self.handle.registerTimer(max(us // 1000, watermark_ms) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, elements = None, []
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
            elements.append((times, *(frame[name].tolist() for name in self.names)))
            first = min(times) if first is None else min(first, *times)
        if elements:
            self.waiting.appendList(elements)
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        columns = [[] for _ in range(1 + len(self.names))]
        for element in self.waiting.get():
            for column, values in zip(columns, element):
                column.extend(values)
        times = columns[0]
        later = [i for i, us in enumerate(times) if us >= watermark_ms * 1000]
        before = [row[0] for row in self.accepted.get()]
        accepted = deque(before)
        if len(later) < len(times):
            ids = columns[1 + self.names.index("request_id")]
            ready = [i for i, us in enumerate(times) if us < watermark_ms * 1000]
            ready.sort(key=lambda i: (times[i], ids[i] is None, 0 if ids[i] is None else ids[i]))
            passed = np.array([times[i] for i in ready], dtype=np.int64)
            decisions = decide(passed, accepted, self.limit, self.window_us)
            self.waiting.clear()
            if later:
                self.waiting.put([tuple([column[i] for i in later] for column in columns)])
            frame = pd.DataFrame({name: [column[i] for i in ready] for name, column in zip(self.names, columns[1:])})
            yield frame.assign(ts=passed.astype("datetime64[us]"), accepted=decisions)[[*self.fields.names, "accepted"]]
        live = bool(later) or bool(accepted) and accepted[-1] + self.window_us > watermark_ms * 1000
        if later:
            self._wake(min(times[i] for i in later), watermark_ms)
        elif live:
            self._wake(accepted[-1] + self.window_us, watermark_ms)
        if not live and before:
            self.accepted.clear()
        elif live and accepted and list(accepted) != before:
            self.accepted.put([(us,) for us in accepted])


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, as list states and timers need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limited_stream(
    log: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS, lateness: str = "5 minutes"
) -> DataFrame:
    """The batch form of the rate limit as a running query.

    A request is decided when the watermark, ``lateness`` behind the newest time seen,
    has passed it; one that comes later than that is dropped by the watermark. So decisions
    do not depend on how the input is cut into micro-batches, and requests within ``lateness`` of the
    end of the input wait for more of it. Times are compared by the microsecond; rows without a client
    or a time belong to no client. State lies in RocksDB
    (``rocks_state``).
    """
    log = log.filter("client is not null and ts is not null")
    out = T.StructType([*log.schema.fields, T.StructField("accepted", T.BooleanType())])
    limiter = RateLimiter(log.schema, limit, window_seconds * 1_000_000)
    return log.withWatermark("ts", lateness).groupBy("client").transformWithStateInPandas(
        limiter, outputStructType=out, outputMode="Append", timeMode="EventTime")
