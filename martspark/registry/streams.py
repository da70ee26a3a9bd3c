"""Running queries: each reads its input as a stream, runs to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators.ratelimit import rate_limited
from martspark.plans import feed, opsmetrics, staging
from martspark.registry.base import iso_time, query, r, rounded
from martspark.registry.feed import (
    ENRICHED, FACTOR, INVENTORY_SQL, INVENTORY_WHERE, MESSAGE_SQL, MIN_QUANTITY, REVENUE_LIMIT, REVENUE_SQL, TX,
    all_transactions, lookup,
)
from martspark.registry.analytics import SLOT
from martspark.session import working_path, written
from martspark.sources import streams, tables
from martspark.streaming import routing, windows

SHORT_LIMIT, SHORT_WINDOW = 2, 3_600  # the test log has one request per client in about three hours


def finished(started):
    started.awaitTermination()
    return started


def run_feed(t):
    """The feed over streamed order lines; returns the output folder and the query."""
    live = streams.StreamedTables(t.spark, t.folder, ["lineitem"])
    events = feed.feed_events(staging.transactions(tables.transactions(live)))
    path = working_path(t.spark, "feed")
    started = routing.start_feed(
        events, lookup(t), path, working_path(t.spark, "feed-checkpoint"), MIN_QUANTITY, FACTOR, REVENUE_LIMIT
    )
    return path, finished(started)


# Fields of the messages that the feed writes.
MESSAGE_FIELDS = {
    "enriched": """txn_id string, customer_id long, product_id long, description string, quantity int, unit_price double,
        revenue double, country string, timestamp timestamp, category string, revenue_rank long, is_top_seller boolean""",
    "alerts.inventory": """alert_type string, store_id string, product_id long, quantity int, threshold double,
        timestamp timestamp""",
    "alerts.revenue": """alert_type string, txn_id string, customer_id long, revenue double, product_id long,
        timestamp timestamp""",
}


def outputs(t, name):
    path, _ = run_feed(t)
    return routing.read_output(t.spark, path, name, MESSAGE_FIELDS[name])


@query("r04_streamed_enriched", f"WITH {ENRICHED} SELECT {MESSAGE_SQL} FROM enriched")
def _(t):
    """The enriched output of the running feed."""
    return rounded(outputs(t, "enriched"), unit_price=4)


@query("r04_streamed_inventory_alerts", f"WITH {ENRICHED} SELECT {INVENTORY_SQL} FROM enriched WHERE {INVENTORY_WHERE}")
def _(t):
    return outputs(t, "alerts.inventory")


@query("r04_streamed_revenue_alerts", f"WITH {ENRICHED} SELECT {REVENUE_SQL} FROM enriched WHERE revenue > {REVENUE_LIMIT}")
def _(t):
    return outputs(t, "alerts.revenue")


@query("r06_feed_progress", f"""WITH {ENRICHED}
SELECT count(*) AS processed, count(*) FILTER ({INVENTORY_WHERE}) + count(*) FILTER (revenue > {REVENUE_LIMIT}) AS alerts_sent
FROM enriched""")
def _(t):
    """Counters that each micro-batch of the feed leaves behind, summed."""
    path, _ = run_feed(t)
    return routing.progress_counters(t.spark, path).agg(
        F.sum("processed").alias("processed"), F.sum("alerts_sent").alias("alerts_sent")
    )


@query("s07_alert_topics", f"""WITH {ENRICHED}
SELECT 'alerts.inventory' AS topic, '⚠️  INVENTORY' AS label, count(*) AS alerts FROM enriched WHERE {INVENTORY_WHERE}
UNION ALL SELECT 'alerts.revenue', '💰 REVENUE', count(*) FROM enriched WHERE revenue > {REVENUE_LIMIT}""")
def _(t):
    """Both alert outputs read back as one stream."""
    path, _ = run_feed(t)
    schema = T.StructType([T.StructField("alert_type", T.StringType()), T.StructField("product_id", T.LongType())])
    both = routing.alert_stream(t.spark, path, schema)
    label = F.lit(feed.OTHER_ALERT_LABEL)
    for kind, text in feed.ALERT_LABELS.items():
        label = F.when(F.col("alert_type") == kind, text).otherwise(label)
    out = working_path(t.spark, "alerts")
    finished(windows.run_to_table(both.withColumn("label", label), out, working_path(t.spark, "alerts-checkpoint")))
    return t.spark.read.parquet(out).groupBy("topic", "label").agg(F.count(F.lit(1)).alias("alerts"))


@query("s06_parsed_messages", f"""WITH {TX}
SELECT CAST(invoice_id AS VARCHAR) AS txn_id, customer_id, CAST(product_id AS VARCHAR) AS product_id,
       product_name AS description, CAST(quantity AS BIGINT) AS quantity, {r('unit_price', 4)} AS unit_price, revenue,
       country, {iso_time('invoice_ts')} AS timestamp FROM tx""")
def _(t):
    """Transactions to JSON messages, read back as a stream and parsed."""
    path, out = working_path(t.spark, "messages"), working_path(t.spark, "parsed")
    events = feed.feed_events(all_transactions(t)).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    streams.json_messages(events).write.text(path)
    messages = t.spark.readStream.schema("value string").text(path)
    finished(windows.run_to_table(streams.parsed_messages(messages), out, working_path(t.spark, "parsed-checkpoint")))
    return rounded(t.spark.read.schema(streams.parsed_messages(messages).schema).parquet(out), unit_price=4)


@query("s09_ordered_replay", f"""WITH {TX}
SELECT count(*) AS messages, true AS in_order, {r('sum(revenue)', 2)} AS revenue FROM tx""")
def _(t):
    """The feed as files in time order, written by one range partitioning, with the spans of the files checked."""
    path = working_path(t.spark, "ordered")
    feed.feed_events(all_transactions(t)).repartitionByRange("timestamp").sortWithinPartitions("timestamp").withColumn(
        "part", F.spark_partition_id()).write.parquet(path)
    spans = t.spark.read.parquet(path).groupBy("part").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("m")
    )
    # One row per file.
    ahead = F.coalesce(F.lag("hi").over(Window.orderBy("part")) <= F.col("lo"), F.lit(True))
    return rounded(
        spans.withColumn("_ok", ahead).agg(
            F.sum("n").alias("messages"), F.every("_ok").alias("in_order"), F.sum("m").alias("revenue")
        ),
        revenue=2,
    )


@query("s06_deduplicated_stream", "SELECT count(*) AS requests, count(DISTINCT event_id) AS ids FROM events")
def _(t):
    """Redelivered messages are dropped: the log is streamed from two copies."""
    path, out = working_path(t.spark, "twice"), working_path(t.spark, "once")
    log = tables.request_log(t).withColumnRenamed("ts", "timestamp")
    log.union(log).write.parquet(path)
    live = streams.parquet_stream(t.spark, path, log.schema)
    finished(streams.start_without_repeats(live, ["request_id"], out, working_path(t.spark, "once-checkpoint")))
    return t.spark.read.parquet(out).agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("request_id").alias("ids")
    )


def streamed_log(t):
    live = streams.StreamedTables(t.spark, t.folder, ["events"])
    return tables.request_log(live).withWatermark("ts", "10 minutes")


@query("r08_streamed_request_rate", f"""SELECT {iso_time(SLOT)} AS window_start, event_type AS endpoint,
{r('count(*) / 300.0', 6)} AS rate FROM events GROUP BY ALL""")
def _(t):
    """R8 as a running query; update mode, so that no window waits for the watermark and closed ones are forgotten."""
    out = working_path(t.spark, "rates")
    rates = opsmetrics.request_rate(streamed_log(t))
    finished(windows.run_updates(rates, out, working_path(t.spark, "rates-checkpoint")))
    return rounded(windows.newest(t.spark, out, rates.schema, ["window_start", "endpoint"]), rate=6)


# Requests of a client one after the other, with the accepted times that still count.
RATE_LIMITED = f"""WITH RECURSIVE log AS (
  SELECT event_id AS request_id, ts, event_type AS endpoint, user_id AS client, value AS latency, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
step AS (
  SELECT *, [us] AS live, true AS accepted FROM log WHERE rn = 1
  UNION ALL
  SELECT request_id, ts, endpoint, client, latency, us, rn,
         CASE WHEN len(kept) < {SHORT_LIMIT} THEN list_append(kept, us) ELSE kept END, len(kept) < {SHORT_LIMIT}
  FROM (SELECT l.*, [x FOR x IN s.live IF l.us - x < {SHORT_WINDOW * 1_000_000}] AS kept
        FROM step s JOIN log l ON l.client IS NOT DISTINCT FROM s.client AND l.rn = s.rn + 1))
SELECT request_id, {iso_time('ts')} AS ts, endpoint, client, latency, accepted FROM step"""


@query("r12_rate_limited", RATE_LIMITED)
def _(t):
    """R12 on the batch side."""
    return rate_limited(tables.request_log(t), SHORT_LIMIT, SHORT_WINDOW)


@query("r12_streamed_rate_limit", RATE_LIMITED)
def _(t):
    """R12 as a stateful stream over the log; a last request, long after, moves the watermark past all others."""
    path, out = working_path(t.spark, "requests"), working_path(t.spark, "limited")
    log = tables.request_log(t)
    ending = log.agg(*(F.max(c).alias(c) for c in log.columns)).withColumns({
        "ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "request_id": F.lit(-1).cast("long")}).select(*log.columns)
    log.repartition(3).write.parquet(path)
    ending.write.mode("append").parquet(path)
    live = streams.parquet_stream(t.spark, path, log.schema, files_per_trigger=2)
    limited = windows.rate_limited_stream(live, SHORT_LIMIT, SHORT_WINDOW, lateness="30 days")
    with windows.rocks_state(t.spark):
        finished(windows.run_to_table(limited, out, working_path(t.spark, "limited-checkpoint")))
    return t.spark.read.parquet(out)
