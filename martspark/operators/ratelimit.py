"""Sliding-window rate limit: at most ``limit`` accepted requests in the trailing window.

A request is accepted when fewer than ``limit`` accepted requests of its client
are younger than the window; one exactly as old as the window no longer counts.
Rejected requests do not count. Whether a request passes depends on what was
accepted before, so a client's requests are decided in time order; the state to
carry along is no more than ``limit`` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATE_LIMIT, RATE_WINDOW_SECONDS = 10, 60


def decide(times_us: np.ndarray, accepted: deque, limit: int, window_us: int) -> list[bool]:
    """Decisions for ascending times; ``accepted`` holds the live accepted times and is updated.

    While the limit is reached, the next request that can pass is the first at
    least a window after the oldest accepted one; it is found by a search, so the
    work grows with the accepted requests and not with the rejected ones.
    """
    decisions, at = np.zeros(len(times_us), dtype=bool), 0
    while at < len(times_us):
        if limit <= 0:
            break
        if len(accepted) >= limit and times_us[at] - accepted[0] < window_us:
            at = int(np.searchsorted(times_us, accepted[0] + window_us))
            continue
        while accepted and times_us[at] - accepted[0] >= window_us:
            accepted.popleft()
        accepted.append(int(times_us[at]))
        decisions[at] = True
        at += 1
    return decisions.tolist()


def with_chains(log: DataFrame, window_seconds: int) -> DataFrame:
    """Add ``chain``: runs of requests whose gaps are shorter than the window.

    After a gap as long as the window nothing is remembered, so chains are
    independent and can be decided in parallel. Requests are first reduced to
    the earliest and latest time per client and slot of half a window; only
    those slots are compared with their predecessor. Two slots that follow each
    other without a gap of a whole window belong to one chain.
    """
    slot_us = window_seconds * 500_000
    slotted = log.withColumn("_us", F.unix_micros("ts")).withColumn("_slot", F.floor(F.col("_us") / slot_us))
    slots = slotted.groupBy("client", "_slot").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    ordered = Window.partitionBy("client").orderBy("_slot")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi", 1).over(ordered) >= window_seconds * 1_000_000, F.lit(True))
    marked = slots.withColumn("_start", F.when(starts, F.col("_slot")))
    chain = F.max("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    chains = marked.select("client", "_slot", chain.alias("chain"))
    return slotted.join(chains, ["client", "_slot"]).drop("_slot")


def rate_limited(log: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Request log with the decision of each request.

    Rows are partitioned by chain and sorted inside the partition, then read as
    a stream of batches: a task holds one batch and at most ``limit`` times,
    however long a chain is.
    """
    window_us = window_seconds * 1_000_000
    columns = log.columns

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for frame in frames:
            keys = list(zip(frame["client"], frame["chain"]))
            times = frame["_us"].to_numpy()
            decisions, start = [], 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != current:
                    current, accepted = keys[start], deque()
                decisions += decide(times[start:end], accepted, limit, window_us)
                start = end
            yield frame[columns].assign(accepted=decisions)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    return (
        with_chains(log, window_seconds)
        .repartition("client", "chain")
        .sortWithinPartitions("client", "chain", "_us", "request_id")
        .mapInPandas(scan, f"{fields}, accepted boolean")
    )
