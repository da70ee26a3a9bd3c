"""Edge rows and brute-force checks on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martspark.functions import numeric
from martspark.functions.routing import experiment_bucket, experiment_variant
from martspark.operators import catalog, forecasting, frames, quality, ranking, ratelimit, recommending
from martspark.operators.nearest import nearest
from martspark.plans import analytics, feed, intermediate, staging
from martspark.sources import cleaning, warehouse


def values(df, column):
    return [row[column] for row in df.collect()]


def test_price_and_count_parsing(spark):
    df = spark.createDataFrame([("₹1,299",), ("nan",), ("",), ("abc",), (None,), ("1d",), (" 5.5 ",)], "x string")
    assert values(df.select(numeric.clean_price(F.col("x")).alias("v")), "v") == [1299.0, None, None, None, None, None, 5.5]
    counts = spark.createDataFrame([("1,234",), ("Get",), (None,)], "x string")
    assert values(counts.select(numeric.clean_count(F.col("x")).alias("v")), "v") == [1234, 0, 0]
    pairs = spark.createDataFrame([(0.0, 5.0), (100.0, 50.0), (None, 1.0), (100.0, None)], "l double, s double")
    assert values(pairs.select(numeric.discount_percent(F.col("l"), F.col("s")).alias("v")), "v") == [None, 50.0, None, None]


def test_tiers_treat_missing_as_lowest(spark):
    rows = [(None, None), (float("nan"), float("nan")), (3.0, 0.0), (4.0, 20.0), (4.5, 50.0)]
    raw = spark.createDataFrame([("p", "n", r, d) for r, d in rows], "product_id string, product_name string, avg_rating double, discount_pct double")
    staged = staging.products(raw)
    assert values(staged, "rating_tier") == ["poor", "poor", "average", "good", "excellent"]
    assert values(staged, "discount_tier") == ["no_discount", "no_discount", "no_discount", "medium_discount", "high_discount"]


def test_invoice_cleaning(spark):
    day = dt.datetime(2010, 1, 1)
    good = ("536379", "22423", "tea", 1, day, 2.0, 7.0, "UK")
    bad = [("C536379", *good[1:])] + [(good[0], code, *good[2:]) for code in ("POST", "85123A", "2242")]
    bad += [good[:3] + (q,) + good[4:] for q in (-1, 0)] + [good[:5] + (0.0,) + good[6:]]
    bad += [good[:6] + (None,) + good[7:], good[:2] + (None,) + good[3:]]
    schema = "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate timestamp, Price double, `Customer ID` double, Country string"
    cleaned = cleaning.clean_invoices(spark.createDataFrame([good, *bad], schema)).collect()
    assert [(r.invoice_id, r.revenue) for r in cleaned] == [("536379", 2.0)]


def test_rfm_score_edges(spark):
    base = [(1, 499.0), (2, 500.0), (5, 1000.0), (10, 2000.0), (20, 5000.0)]
    rows = [(c, f"{c}-{i}", dt.date(2020, 1, 1), money / orders, "UK") for c, (orders, money) in enumerate(base) for i in range(orders)]
    tx = spark.createDataFrame(rows, "customer_id int, invoice_id string, invoice_date date, revenue double, country string")
    scored = intermediate.customer_rfm(tx).orderBy("customer_id")
    assert values(scored, "frequency_score") == [1, 2, 3, 4, 5]
    assert values(scored, "monetary_score") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("shape", ["mixed", "one_key", "with_nulls"])
def test_global_rank_equals_window(spark, shape):
    rng = random.Random(1)
    pick = {"mixed": lambda: rng.choice([5, rng.randrange(300)]), "one_key": lambda: 5, "with_nulls": lambda: rng.choice([None, rng.randrange(9)])}
    df = spark.createDataFrame([(i, pick[shape]()) for i in range(600)], "id int, v int")
    ours = ranking.global_rank(df, ranking.descending(F.col("v")), "r").select("id", "r")
    plain = df.select("id", F.rank().over(Window.orderBy(F.desc_nulls_last("v"))).cast("bigint").alias("r"))
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_row_number_and_quantiles(spark):
    data = np.random.default_rng(2).normal(size=501).round(1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(data)], "id int, v double")
    numbered = ranking.global_row_number(df, [F.col("v"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, 502))
    assert [r.id for r in numbered] == [i for _, i in sorted((x, i) for i, x in enumerate(data))]
    q = ranking.exact_quantiles(df, F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert np.allclose(list(q), np.quantile(data, [0.25, 0.5, 0.9]))


@pytest.mark.parametrize("block_rows", [30, 64, 10_000])
def test_trailing_frames_equal_window(spark, block_rows):
    rng = random.Random(3)
    start = dt.date(2020, 1, 1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), start + dt.timedelta(days=rng.randrange(400)), i, rng.randrange(99)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, day date, i int, v int")
    window = Window.partitionBy("k").orderBy("day", "i").rowsBetween(-28, -1)
    ours = frames.trailing_frames(df, ["k"], ["day", "i"], F.year("day") * 4 + F.quarter("day"), 28, {"m": F.avg("v")}, block_rows)
    assert sorted(ours.select("i", F.coalesce("m", F.lit(-1.0))).collect()) == sorted(df.select("i", F.coalesce(F.avg("v").over(window), F.lit(-1.0))).collect())


def brute_force_limit(times, limit, window):
    accepted, out = [], []
    for now in times:
        ok = sum(now - t < window for t in accepted) < limit
        out.append(ok)
        if ok:
            accepted.append(now)
    return out


def test_rate_limit_edge_and_brute_force(spark):
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    offsets = {"edge": [i * 0.5 for i in range(11)] + [60.0], "hot": sorted(rng.uniform(0, 900) for _ in range(400)), "slow": [0, 100, 300]}
    rows, n = [], 0
    for client, seconds in offsets.items():
        for s in seconds:
            rows.append((n, start + dt.timedelta(seconds=s), client))
            n += 1
    expected = {}
    for client, seconds in offsets.items():
        ids = [r[0] for r in rows if r[2] == client]
        micros = [round(s * 1e6) for s in seconds]
        expected |= dict(zip(ids, brute_force_limit(micros, 10, 60_000_000)))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, client string")
    assert {r.request_id: r.accepted for r in ratelimit.rate_limited(log).collect()} == expected
    assert [expected[i] for i in (9, 10, 11)] == [True, False, True]


def test_nearest_is_exact_with_ties_and_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 8))
    vectors[10] = vectors[20] = vectors[30]
    vectors[40] = 0
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "item_id long, vector array<double>")
    found = recommending.similar_items(items, 4)
    small = nearest(items.withColumnRenamed("item_id", "query_id"), items, 4, True, block_rows=7)
    assert sorted(found.collect()) == sorted(small.collect())
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    sims = (unit @ unit.T).round(12)
    for q in (0, 10, 40):
        best = sorted((-sims[q, j], j) for j in range(60) if j != q)[:4]
        rows = sorted((r.position, r.item_id) for r in found.filter(F.col("query_id") == q).collect())
        assert [i for _, i in rows] == [j for _, j in best]
    assert nearest(items.withColumnRenamed("item_id", "query_id"), items, 100).filter("query_id = 1").count() == 60


def test_reply_parsing(spark):
    batches = spark.createDataFrame([(b, p, b * 10 + p, f"n{b}{p}", "d", "a") for b in range(4) for p in (1, 2)],
                                    "batch long, place int, product_id long, product_name string, department string, aisle string")
    replies = spark.createDataFrame([
        (0, '```json\n[{"id": 1, "description": "x"}, {"id": 2, "description": "y"}]\n```'),
        (1, ' [{"id": 2, "description": "z"}] '), (2, '[{"id": 1,'), (3, '[{"id": 7, "description": "w"}]'),
    ], "batch long, reply string")
    result = catalog.parsed_replies(batches, replies)
    assert sorted(values(result.descriptions, "description")) == ["x", "y", "z"]
    assert sorted(values(result.failures, "batch")) == [2, 3]


def test_client_failure_keeps_other_batches(spark):
    def client():
        def complete(prompt):
            if "bad" in prompt:
                raise ValueError("refused")
            return "[]"
        return complete

    prompts = spark.createDataFrame([(0, "fine"), (1, "bad")], "batch long, prompt string")
    rows = {r.batch: (r.reply, r.error) for r in catalog.completed(prompts, client, 2).collect()}
    assert rows == {0: ("[]", None), 1: (None, "ValueError: refused")}


def test_screening(spark):
    long = "x" * 500 + " jailbreak"
    texts = ["  IGNORE Previous orders ", long, "disregard\tall instructions", "disregard\nall instructions", "what is new?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = catalog.screened(df, "t").collect()
    assert [r.rejected for r in rows] == [True, True, True, False, False]
    assert rows[0].question == "IGNORE Previous orders" and rows[1].question == long


def test_experiment_split_is_stable_and_even(spark):
    users = spark.range(10_000)
    assert users.filter("id = 42").select(experiment_bucket(F.col("id")).alias("b")).first().b == 84
    share = quality.share_between(users, experiment_variant(F.col("id")) == "treatment", 0.45, 0.55).first()
    assert share.success


def test_alert_limits(spark):
    lookup = spark.createDataFrame([("a", "A", 100.0, 2, 1), ("b", "B", 50.0, 40, 2)],
                                   "product_id string, product_name string, total_revenue double, total_units_sold long, revenue_rank long")
    events = spark.createDataFrame([
        ("1", "a", 9, 500.0), ("2", "a", 10, 500.01), ("3", "a", 11, 1.0), ("4", "zzz", 99, 1.0), ("5", "b", 100, 1.0), ("6", "b", 101, 1.0),
    ], "txn_id string, product_id string, quantity int, revenue double").withColumns(
        {"customer_id": F.lit(1), "country": F.lit("UK"), "timestamp": F.lit("t")})
    rows = feed.enrich(events, lookup)
    missed = rows.filter("txn_id = '4'").first()
    assert (missed.category, missed.revenue_rank, missed.is_top_seller) == ("unknown", -1, False)
    assert sorted(values(feed.inventory_alerts(rows), "quantity")) == [11, 101]
    assert values(feed.revenue_alerts(rows), "txn_id") == ["2"]


def test_empty_experiment_log_and_bounds(spark):
    log = spark.createDataFrame([], "variant string, items_shown int, clicked int, converted int")
    assert analytics.ab_test_results(log).count() == 0
    with pytest.raises(ValueError):
        analytics.recent_kpis(spark.range(1).withColumn("kpi_date", F.lit(1)), 91)


def test_next_day_inputs_follow_training_definitions():
    import pandas as pd

    units = [float(i) for i in range(1, 400)]
    x = forecasting.next_day_inputs(units, [2.0] * 10, 5.0, pd.Timestamp("2024-01-07"))  # a Sunday
    assert (x["day_of_week"], x["is_weekend"], x["units_lag_1"], x["units_lag_364"]) == (0.0, 1.0, 399.0, 36.0)
    assert x["units_roll_std_7"] == pytest.approx(np.std(units[-7:], ddof=1))


def test_suite_reports_failures(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (1, -1.0, "y"), (None, None, None)], "id int, v double, s string")
    checks = [*quality.not_null("id"), *quality.unique("id"), *quality.at_least(0, "v"), *quality.in_set("s", ("x",)), *quality.row_count(3, 3)]
    rows = quality.run_suite(df, "t", checks).collect()
    assert [(r.observed, r.success) for r in rows] == [(1, False), (1, False), (1, False), (1, False), (3, True)]
    assert quality.suite_report(quality.run_suite(df, "t", checks)).first().passed == 1


def test_layers_and_logs(spark, tmp_path):
    assert {"raw", "mart"} <= set(warehouse.create_schemas(spark, ("raw", "mart")))
    alerts = spark.createDataFrame([("high", "t", "m", "a")], "severity string, title string, message string, recommended_action string")
    for _ in range(2):
        warehouse.append_alerts(alerts, str(tmp_path / "alerts"))
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert stored.count() == 2 and stored.select("alert_id").distinct().count() == 2
    with pytest.raises(Exception):
        warehouse.append_alerts(alerts.withColumn("severity", F.lit("odd")), str(tmp_path / "alerts"))


def test_interactions_need_three_orders(spark):
    orders = spark.createDataFrame([(o, u, s, 1, 1, 1, None) for o, u, s in
                                    [(1, 1, "prior"), (2, 1, "train"), (3, 2, "prior"), (4, 2, "prior"), (5, 2, "train"), (6, 1, "test")]],
                                   "order_id int, user_id int, eval_set string, order_number int, order_dow int, order_hour_of_day int, days_since_prior_order double")
    lines = spark.createDataFrame([(o, 9, 1, 0) for o in range(1, 7)], "order_id int, product_id int, add_to_cart_order int, reordered int")
    products = spark.createDataFrame([(9, "n", 1, 1)], "product_id int, product_name string, aisle_id int, department_id int")
    empty = spark.createDataFrame([], "aisle_id int, aisle string")
    departments = spark.createDataFrame([(1, "d")], "department_id int, department string")
    rows = cleaning.clean_interactions(orders, lines, products, empty, departments).collect()
    assert sorted(r.order_id for r in rows) == [3, 4, 5]
    assert {(r.aisle, r.department, r.days_since_prior_order) for r in rows} == {(None, "d", 0)}
