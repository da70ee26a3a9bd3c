"""What the factors, the exact search and the bucket search hold and send at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martspark.functions.vectors import unit_vector
from martspark.operators import alternating, buckets, latent
from martspark.operators import nearest as nearest_op


def laid_out(rng, sizes, vectors):
    count = np.array(sizes, np.int32)
    n = int(count.sum())
    return count, rng.integers(0, vectors, n).astype(np.int32), (rng.random(n) * 3 + 0.05).astype(np.float32)


@pytest.mark.parametrize("reg", [0.01, 1e-13])
def test_ids_with_few_ratings_are_solved_by_their_ratings(monkeypatch, reg):
    """The same solution as the equations as wide as a vector, from equations as many as an id has ratings."""
    rng, rank = np.random.default_rng(3), 16
    vectors = (rng.normal(size=(200, rank)) * np.linspace(2, 0.05, rank)).astype(np.float32)
    count, at, rating = laid_out(rng, [0, 3, 3, 1, 0, 16, 40, 17, 3], len(vectors))
    at[:3] = 5  # an id that has one vector three times
    gram, plain, shapes = alternating._gram(vectors), np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: shapes.append(a.shape[-1]) or plain(a, b))
    found = alternating.solved(vectors, count, at, rating, gram, reg)
    assert sorted(shapes) == [1, 3, 16, 16, 16]
    ends = np.cumsum(count)
    for k, (size, end) in enumerate(zip(count, ends)):
        y, c = vectors[at[end - size:end]].astype(float), rating[end - size:end].astype(float)
        wanted = plain(gram + (y * c[:, None]).T @ y + size * reg * np.eye(rank), (1 + c) @ y) if size else np.zeros(rank)
        assert np.allclose(found[k], wanted, atol=1e-5)


def test_vectors_without_strength_on_an_axis_keep_the_wide_equations(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = np.zeros((20, 4), np.float32)
    vectors[:, :2] = rng.normal(size=(20, 2))
    shapes, plain = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: shapes.append(a.shape[-1]) or plain(a, b))
    found = alternating.solved(vectors, *laid_out(rng, [2, 1], 20), alternating._gram(vectors), 1e-12)
    assert shapes == [4, 4] and np.isfinite(found).all()


def test_search_sorts_winners_once_enough_have_come(monkeypatch):
    """Rows equal a full sort, also with ties and own pairs, and sorts are far fewer than tiles."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    items, vectors = unit(rng.normal(size=(4_000, 8))), unit(rng.normal(size=(30, 8)))
    items[3_000:3_200] = items[100:300]  # ties far apart
    own = (np.arange(30), rng.integers(0, 4_000, 30))
    sorts, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or plain(keys))
    rows, columns, values = nearest_op.best_columns(vectors, items, 10, own, tile_rows=32)
    exact = np.round(vectors @ items.T, nearest_op.DECIMALS)
    exact[own] = -np.inf
    order = np.argsort(-exact, axis=1, kind="stable")[:, :10]
    assert np.array_equal(columns.reshape(30, 10), order) and np.array_equal(rows, np.repeat(np.arange(30), 10))
    assert np.allclose(values.reshape(30, 10), np.take_along_axis(exact, order, 1), atol=1e-11)
    assert len(sorts) < 20


@pytest.mark.parametrize("share", [0.05, 1.0])
def test_search_sends_vectors_without_their_zeros(spark, share):
    """Rows are those of a full sort; mostly empty vectors travel as their few numbers."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(600, 200)) * (rng.random((600, 200)) < share)
    rows[5] = 0.0
    rows[6], rows[7] = rows[8], rng.normal(size=200)
    frame = spark.createDataFrame([(f"d{k:03d}", x.tolist()) for k, x in enumerate(rows)], "item_id string, vector array<double>")
    sent = nearest_op.packed(frame, "item_id").selectExpr("sum(coalesce(length(places), 0) + length(numbers)) as n").first().n
    assert sent < 200 * 600 * 8 * 0.25 if share < 1 else sent == 200 * 600 * 8
    found = nearest_op.nearest(frame.withColumnRenamed("item_id", "query_id"), frame, 4, exclude_self=True, block_rows=90).collect()
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-8)
    exact = np.round(unit @ unit.T, nearest_op.DECIMALS)
    np.fill_diagonal(exact, -np.inf)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :4]
    got = {(r.query_id, r.position): r.item_id for r in found}
    assert got == {(f"d{i:03d}", j + 1): f"d{order[i, j]:03d}" for i in range(600) for j in range(4)}


def test_larger_blocks_where_vectors_are_mostly_empty(spark, monkeypatch):
    widths, plain = [], nearest_op._block_rows
    monkeypatch.setattr(nearest_op, "_block_rows", lambda q, c, width, cores: widths.append(width) or plain(q, c, width, cores))
    frame = spark.range(50).selectExpr("id as item_id", "transform(sequence(0, 511), i -> if(i = id, 1D, 0D)) as vector")
    assert nearest_op.nearest(frame.withColumnRenamed("item_id", "query_id"), frame, 1).filter("query_id = item_id").count() == 50
    assert widths == [2]


def test_bucket_search_writes_no_vectors(spark, tmp_path, monkeypatch):
    """Single and double precision give the rows of unit vectors as Spark computes them; only large buckets are written."""
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=16)]) for k in range(400)]
    rows += [(400, [0.0] * 16), (401, rows[0][1])]
    frame = spark.createDataFrame(rows, "item_id long, vector array<float>")
    tables, plain = [], buckets.written
    monkeypatch.setattr(buckets, "written", lambda df, label: tables.append(plain(df, label)) or tables[-1])
    found = {}
    for kind in ("float", "double"):
        of = frame.withColumn("vector", frame["vector"].cast(f"array<{kind}>"))
        found[kind] = {(r.query_id, r.position): (r.item_id, r.similarity) for r in buckets.near(
            of.withColumnRenamed("item_id", "query_id"), of, 5, True, bucket_rows=100, group_rows=60).collect()}
    assert found["float"] == found["double"] and len(found["float"]) > 1_500
    assert not any("vector" in t.columns or "item_id" in t.columns for t in tables)
    assert all(t.count() > 0 for t in tables)  # buckets and cells of more than 60 rows, so both are split
    unit = {r.item_id: np.array(r.u) for r in frame.select("item_id", unit_vector(frame["vector"]).alias("u")).collect()}
    for (query, _), (item, similarity) in found["float"].items():
        assert abs(similarity - unit[query] @ unit[item]) < 1e-11
    raw = np.array([np.float32(x).tobytes() for _, x in rows], dtype=object)
    assert np.array_equal(buckets._units(raw, np.dtype(np.float32)), np.stack([unit[k] for k, _ in rows]))


@pytest.mark.parametrize("ids, blocks", [(100, 4), (2_000, 20)])
def test_blocks_of_ratings_name_bounded_vectors(spark, monkeypatch, ids, blocks):
    """A task holds the vectors that its ratings name: fewer ratings a block once the ids are too many to be held."""
    rng = np.random.default_rng(10)
    rows = [(int(u), int(i), 1.0) for u, i in zip(rng.integers(0, 100, 4_000), rng.integers(0, ids, 4_000))]
    frame = spark.createDataFrame(rows, "u int, i int, r double")
    counts, plain = [], alternating.rating_blocks
    monkeypatch.setattr(alternating, "rating_blocks", lambda ratings, n: counts.append(n) or plain(ratings, n))
    for name, value in (("FEW_RATINGS", 10**9), ("BLOCK_RATINGS", 1_000), ("BLOCK_VALUES", 800)):
        monkeypatch.setattr(alternating, name, value)
    alternating.alternating_factors(frame, "u", "i", "r", rank=4, iterations=1, regularisation=0.01, seed=1)
    assert counts == [blocks, blocks]


def test_latent_fit_reads_the_texts_once(spark):
    """Every pass after the first goes over the written buckets."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    texts = spark.range(40).selectExpr("concat('word', id % 7, ' thing', id % 3) as raw").repartition(2).select(
        F.udf(seen, "string")("raw").alias("text"))
    encoder = latent.LatentEncoder.fit(texts, "text", dimensions=3, buckets=64)
    assert read.value == 40 and encoder.axes.shape == (64, 3)
