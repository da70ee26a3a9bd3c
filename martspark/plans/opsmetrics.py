"""Service metrics as windowed queries over a request log.

All functions take a batch or a streaming frame with ``ts``, ``endpoint`` and
``latency``; a streaming frame needs a watermark on ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE_WINDOW = "5 minutes"
RATE_SECONDS = 300

# Upper bounds of the default latency histogram, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def _windowed(log: DataFrame, *measures: Column) -> DataFrame:
    grouped = log.groupBy(F.window("ts", RATE_WINDOW).alias("w"), "endpoint").agg(*measures)
    return grouped.withColumn("window_start", F.col("w.start")).drop("w")


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per second and endpoint over five-minute windows."""
    return _windowed(log, (F.count(F.lit(1)) / RATE_SECONDS).alias("rate"))


def mean_latency(log: DataFrame) -> DataFrame:
    return _windowed(log, F.avg("latency").alias("mean_latency"))


def latency_quantiles(log: DataFrame, quantiles: dict[str, float], bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Quantiles estimated from a latency histogram.

    A window keeps one cumulative counter per bound however many requests fall
    into it. Inside the bucket that holds the wanted rank the value is
    interpolated; above the last bound the last bound is reported.
    """
    counters = [F.count_if(F.col("latency") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    counted = _windowed(log, F.count(F.lit(1)).alias("requests"), *counters)

    def estimate(q: float) -> Column:
        rank = F.lit(q) * F.col("requests")
        branches = []
        for i, upper in enumerate(bounds):
            here = F.col(f"le_{i}")
            below = F.col(f"le_{i - 1}") if i else F.lit(0)
            lower = bounds[i - 1] if i else 0.0
            share = (rank - below) / F.nullif((here - below).cast("double"), F.lit(0.0))
            branches.append(F.when(here >= rank, F.lit(lower) + F.lit(upper - lower) * F.coalesce(share, F.lit(0.0))))
        return F.coalesce(*branches, F.lit(bounds[-1]))

    return counted.select(
        "window_start", "endpoint", "requests", *[estimate(q).alias(name) for name, q in quantiles.items()]
    )


def total_requests(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_requests"))


def hourly_increase(log: DataFrame) -> DataFrame:
    """Requests per endpoint in every hour that starts on a five-minute step.

    Requests are counted per five minutes first; only those counts, not the
    requests, are repeated for the twelve hours they belong to.
    """
    steps = _windowed(log, F.count(F.lit(1)).alias("n"))
    hours = steps.groupBy(F.window("window_start", "1 hour", RATE_WINDOW).alias("w"), "endpoint").agg(
        F.sum("n").alias("requests")
    )
    return hours.select(F.col("w.start").alias("window_start"), "endpoint", "requests")
