"""The enriched feed as a running query: one input, three outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martspark.plans import feed
from martspark.sources.streams import json_messages

OUTPUTS = ("enriched", "alerts.inventory", "alerts.revenue")
COUNTERS = "counters"


def counters(batch: DataFrame, min_quantity: int, factor: float, revenue_limit: float) -> DataFrame:
    """One row: processed rows and alerts of a micro-batch."""
    usual = F.col("product_units") / F.greatest(F.col("revenue_rank"), F.lit(1))
    large = (F.col("revenue_rank") != -1) & (F.col("quantity") >= min_quantity) & (F.col("quantity") > usual * factor)
    return batch.agg(
        F.count(F.lit(1)).alias("processed"),
        (F.count_if(large) + F.count_if(F.col("revenue") > revenue_limit)).alias("alerts_sent"),
    )


def start_feed(
    events: DataFrame,
    lookup: DataFrame,
    path: str,
    checkpoint: str,
    min_quantity: int = feed.MIN_ALERT_QUANTITY,
    factor: float = feed.VOLUME_FACTOR,
    revenue_limit: float = feed.REVENUE_LIMIT,
) -> StreamingQuery:
    """Enrich a stream and write messages and both kinds of alert.

    A micro-batch is enriched once and kept while its outputs and counters are written.
    Every output has a folder per batch number and replaces it, so a batch that
    is repeated after a failure leaves no doubles. Messages are compressed: JSON
    repeats its field names in every line.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        parts = {
            "enriched": feed.enriched_messages(batch),
            "alerts.inventory": feed.inventory_alerts(batch, min_quantity, factor),
            "alerts.revenue": feed.revenue_alerts(batch, revenue_limit),
        }
        for name, part in parts.items():
            json_messages(part).write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}/batch={batch_id}")
        counted = counters(batch, min_quantity, factor, revenue_limit)
        counted.write.mode("overwrite").parquet(f"{path}/{COUNTERS}/batch={batch_id}")
        batch.unpersist()

    return (
        feed.enrich(events, lookup).writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_output(spark, path: str, name: str, schema) -> DataFrame:
    """One of the three outputs as a batch frame."""
    lines = spark.read.schema("value string, batch long").text(f"{path}/{name}")
    return lines.select(F.from_json("value", schema).alias("m")).select("m.*")


def progress_counters(spark, path: str) -> DataFrame:
    """Processed rows and alerts of every micro-batch of the feed, however many there were."""
    return spark.read.schema("processed long, alerts_sent long, batch long").parquet(f"{path}/{COUNTERS}")


def alert_stream(spark, path: str, schema) -> DataFrame:
    """Both alert outputs as one stream with the topic of each message."""
    streams = []
    for topic in OUTPUTS[1:]:
        lines = spark.readStream.schema("value string").text(f"{path}/{topic}/*")
        streams.append(lines.withColumn("topic", F.lit(topic)))
    both = streams[0].unionByName(streams[1])
    return both.select("topic", F.from_json("value", schema).alias("m")).select("topic", "m.*")
