"""Findings of round 3: work and memory that must not outgrow the input."""

import re
import time

import numpy as np

from pyspark.sql import functions as F

from martspark.functions.vectors import unit_vector
from martspark.operators import nearest as nearest_op


def test_unit_vector_takes_its_length_once(spark):
    wide = F.transform(F.sequence(F.lit(1), F.lit(8_000)), lambda i: i.cast("float"))
    rows = spark.range(200).select("id", wide.alias("vector"))
    began = time.time()
    total = rows.select(F.aggregate(unit_vector(F.col("vector")), F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in total.collect())
    assert time.time() - began < 20  # once per element it is 12.8 thousand million steps
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [3.0, 4.0])], "id int, vector array<float>")
    assert [r.u for r in odd.orderBy("id").select(unit_vector(F.col("vector")).alias("u")).collect()] == [
        [0.0, 0.0], None, [], [0.6, 0.8]]


def test_product_join_is_cut_by_rows(spark):
    from martspark.session import tasks_for
    from martspark.sources.cleaning import clean_interactions

    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 10, 10) is None and tasks_for(spark, 10 * cores + 1, 10) == cores + 1
    orders = spark.range(300).select(
        F.col("id").alias("order_id"), (F.col("id") % 50).alias("user_id"), F.lit("prior").alias("eval_set"),
        F.lit(1).alias("order_number"), F.lit(1).alias("order_dow"), F.lit(1).alias("order_hour_of_day"),
        F.lit(1.0).alias("days_since_prior_order"))
    lines = spark.range(900).select(
        (F.col("id") % 300).alias("order_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("product_id"),
        F.lit(1).alias("add_to_cart_order"), F.lit(1).alias("reordered"))
    products = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 1), (2, "c", 1, 2)],
                                     "product_id long, product_name string, aisle_id int, department_id int")
    aisles = spark.createDataFrame([(1, "x")], "aisle_id int, aisle string")
    departments = spark.createDataFrame([(1, "y")], "department_id int, department string")
    plain = clean_interactions(orders, lines, products, aisles, departments)
    cut = clean_interactions(orders, lines, products, aisles, departments, tasks=37)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect())) and plain.count() > 900
    assert cut.rdd.getNumPartitions() == 37  # small as they are, the parts are not joined to a few


def test_lines_are_moved_for_order_and_product_only(spark, tmp_path):
    from martspark.sources import tables

    frames = {
        "lineitem": spark.createDataFrame([(1, 1, 2.0, 10.0), (1, 2, 1.0, 5.0), (2, 1, 0.0, 1.0), (9, 1, 1.0, 1.0)],
                                          "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double"),
        "orders": spark.createDataFrame([(1, 7, "2020-01-01"), (2, None, "2020-01-02"), (3, 7, "2020-01-03")],
                                        "o_orderkey long, o_custkey long, o_orderdate string"),
        "customer": spark.createDataFrame([(7, 1), (7, 2)], "c_custkey long, c_nationkey long"),  # a repeated key
        "nation": spark.createDataFrame([(1, "N1"), (2, "N2")], "n_nationkey long, n_name string"),
        "part": spark.createDataFrame([(1, "p")], "p_partkey long, p_name string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = tables.transactions(tables.Tables(spark, str(tmp_path)))
    got = sorted((r.invoice_id, r.product_id, r.country or "", r.description or "") for r in rows.collect())
    assert got == [(1, 1, "N1", "p"), (1, 1, "N2", "p"), (1, 2, "N1", ""), (1, 2, "N2", ""), (2, 1, "", "p")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Join (\w+)", plan) == ["LeftOuter", "Inner", "LeftOuter", "LeftOuter"]  # two joins above the lines


def test_feed_messages_are_compressed(spark, tmp_path):
    from martspark.plans import feed
    from martspark.streaming import routing

    kinds = "txn_id string, customer_id long, product_id long, description string, quantity int, unit_price double, " \
            "revenue double, country string, timestamp timestamp"
    spark.range(2000).selectExpr(
        "string(id) txn_id", "id customer_id", "id % 3 product_id", "'x' description", "20 quantity", "1d unit_price",
        "double(id) revenue", "'N' country", "timestamp'2020-01-01' timestamp").write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
    known = spark.sql("select 0L product_id, 'a' product_name, 1L revenue_rank, 1L total_units_sold, 1d total_revenue")
    routing.start_feed(live, known, f"{tmp_path}/out", f"{tmp_path}/ck", 10, 0.5, 1000.0).awaitTermination()
    back = routing.read_output(spark, f"{tmp_path}/out", "enriched", "txn_id string, category string")
    assert back.filter("category = 'a'").count() == 667 and back.select("txn_id").distinct().count() == 2000
    both = [f for f in (tmp_path / "out").rglob("part-*") if "counters" not in str(f)]
    assert both and all(f.name.endswith(".txt.gz") for f in both)


def test_best_columns_equal_a_full_sort():
    rng = np.random.default_rng(5)
    for items_n, take, copies in ((300, 7, False), (1000, 10, True), (70, 5, True), (5, 9, False)):
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        items, vectors = unit(rng.normal(size=(items_n, 16))), unit(rng.normal(size=(40, 16)))
        if copies:  # equal vectors tie, also over tiles
            items[items_n // 2:] = items[: items_n - items_n // 2]
            items[::9], vectors[:5] = items[0], items[0]
        ids, item_ids = np.arange(40), np.arange(items_n) % 60  # repeated ids
        for own in (None, nearest_op._own_pairs(ids, item_ids)):
            full = np.round(vectors @ items.T, nearest_op.DECIMALS)
            if own is not None:
                assert sorted(zip(*own)) == sorted(zip(*np.nonzero(ids[:, None] == item_ids[None, :])))
                full[own] = -np.inf
            n = min(take, items_n)
            want = np.argsort(-full, axis=1, kind="stable")[:, :n]
            rows, columns, values = nearest_op.best_columns(vectors, items, n, own, tile_rows=64)
            keep = values > -np.inf
            got = {r: columns[keep & (rows == r)].tolist() for r in range(40)}
            assert got == {r: [c for c in want[r] if full[r, c] > -np.inf] for r in range(40)}


def test_blocks_grow_with_the_tables():
    sent = lambda q, c, w, cores: q * -(-c // (b := nearest_op._block_rows(q, c, w, cores))) + c * -(-q // b)
    assert sent(863_400, 1_200_000, 64, 12) < 20_000_000  # rows; 8,192 a block sent 254 million
    assert nearest_op._block_rows(863_400, 1_200_000, 512, 12) * 512 <= nearest_op.BLOCK_VALUES
    assert nearest_op._block_rows(2_000, 2_000, 64, 8) == nearest_op.BLOCK_ROWS
