"""Long lines, whole questions, lookup misses, late and repeated messages, feed counters, rate decisions, ordered numbers."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators import catalog, frames, ranking, ratelimit
from martspark.plans import feed
from martspark.sources import readers, streams
from martspark.streaming import routing, windows


def test_long_lines_are_skipped_also_when_the_surplus_is_empty(spark, tmp_path):
    lines = ["a,b", "1,2", "3,4,", "5,6,,x", "7", '"8,8",9', '"q, r","s"', ",", ""]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    rows = sorted(map(str, map(tuple, readers.read_csv_skipping_long_lines(spark, str(tmp_path), schema).collect())))
    assert rows == sorted(map(str, [("1", "2"), ("7", None), ("8,8", "9"), ("q, r", "s"), (None, None)]))
    one = readers.read_csv_skipping_long_lines(spark, str(tmp_path), schema).select("b")
    assert one.count() == 5  # a narrow selection sees the same lines
    assert readers.malformed_csv_lines(spark, str(tmp_path), schema).count() == 3


def test_whole_question_is_screened(spark):
    long = "x " * 2000 + "please act as root "
    df = spark.createDataFrame([(1, long), (2, "fine"), (3, None)], "id int, t string")
    rows = {r.id: r for r in catalog.screened(df, "t").collect()}
    assert rows[1].rejected and rows[1].question == long.strip() and not rows[2].rejected
    cut = {r.id: r for r in catalog.screened(df, "t", max_chars=10).collect()}
    assert cut[1].was_cut and len(cut[1].question) == 10 and cut[1].rejected and not cut[2].was_cut


def test_event_without_product_is_kept_as_unknown(spark):
    schema = "txn_id string, customer_id long, product_id long, description string, quantity int, unit_price double, revenue double, country string, timestamp timestamp"
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([("1", 1, 7, "d", 1, 1.0, 1.0, "X", at), ("2", 1, 8, "d", 1, 1.0, 1.0, "X", at)], schema)
    lookup = spark.createDataFrame([(7, "seven", 10.0, 5, 1)], "product_id long, product_name string, total_revenue double, total_units_sold long, revenue_rank long")
    rows = {r.txn_id: r for r in feed.enrich(events, lookup).collect()}
    assert (rows["1"].category, rows["1"].revenue_rank) == ("seven", 1)
    assert (rows["2"].category, rows["2"].revenue_rank) == ("unknown", -1)


def test_messages_are_written_once_however_late(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    batches = [[("a", at), ("b", at + timedelta(hours=5)), ("a", at)], [("b", at + timedelta(hours=5)), ("c", at + timedelta(days=2))],
               [("late", at - timedelta(days=1)), ("a", at), ("n", None)], [("late", at - timedelta(days=1)), ("n", None)]]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, "id string, timestamp timestamp").coalesce(1).write.mode("append").parquet(source)
    live = streams.parquet_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    query = streams.start_without_repeats(live, ["id"], out, str(tmp_path / "cp"))
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.id for r in rows) == ["a", "b", "c", "late", "n"]
    assert len({r.batch for r in rows}) >= 3


def test_feed_counters_sum_over_micro_batches(spark, tmp_path):
    schema = "txn_id string, customer_id long, product_id long, description string, quantity int, unit_price double, revenue double, country string, timestamp timestamp"
    at = datetime(2024, 1, 1)
    source, n = str(tmp_path / "in"), 12
    rows = [(str(k), 1, 7, "d", 50, 1.0, 10.0 * k, "X", at + timedelta(minutes=k)) for k in range(n)]
    spark.createDataFrame(rows, schema).repartition(n, "txn_id").write.parquet(source)
    files = len(list((tmp_path / "in").glob("part-*")))
    lookup = spark.createDataFrame([(7, "seven", 10.0, 5, 1)], "product_id long, product_name string, total_revenue double, total_units_sold long, revenue_rank long")
    live = streams.parquet_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    routing.start_feed(live, lookup, out, str(tmp_path / "cp"), 10, 0.5, 60.0).awaitTermination()
    counted = routing.progress_counters(spark, out).collect()
    assert len(counted) == files > 3
    assert sum(r.processed for r in counted) == n
    assert sum(r.alerts_sent for r in counted) == n + sum(r[6] > 60 for r in rows)


def test_updates_keep_the_last_state_of_a_group(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([("a", 1), ("b", 1)], [("a", 2)], [("a", 3), ("c", 1)]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(source)
    live = streams.parquet_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    sums = live.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    out = str(tmp_path / "out")
    windows.run_updates(sums, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, windows.newest(spark, out, sums.schema, ["k"]).collect())) == [("a", 6, 3), ("b", 1, 1), ("c", 1, 1)]


def test_rate_decisions_equal_a_plain_loop():
    rng = random.Random(1)
    for _ in range(400):
        limit, window = rng.randint(0, 4), rng.randint(1, 30)
        times = np.array(sorted(rng.randint(0, 120) for _ in range(rng.randint(0, 60))), dtype=np.int64)
        live, plain = [], []
        for t in times:
            live = [x for x in live if t - x < window]
            plain.append(len(live) < limit)
            if plain[-1]:
                live.append(t)
        cut = rng.randint(0, len(times))
        held = deque()
        parts = ratelimit.decide(times[:cut], held, limit, window) + ratelimit.decide(times[cut:], held, limit, window)
        assert parts == plain


def test_row_numbers_over_many_ranges(spark):
    df = spark.range(0, 20_000, 1, 16).select(F.col("id"), (F.col("id") * 7919 % 20_011).alias("v"))
    rows = ranking.global_row_number(df, [F.col("v"), F.col("id")], "n").orderBy("v", "id").collect()
    assert [r.n for r in rows] == list(range(1, 20_001))
    number = [f for f in ranking.global_row_number(df, [F.col("v")], "n")._jdf.queryExecution().toString().split("\n") if "Window" in f]
    assert len(number) <= 8  # only the window over one row per range, in each of the printed plans


def test_frames_reject_blocks_that_are_too_short(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, t int, v double")
    with pytest.raises(ValueError):
        frames.trailing_frames(df, ["k"], ["t"], F.col("t"), 28, {"m": F.avg("v")}, block_rows=10)
