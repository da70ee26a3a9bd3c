"""Latent text vectors against a dense decomposition, and the plane that keeps neighbours."""

import numpy as np
from pyspark.sql import functions as F

from martspark.operators import latent, plane
from martspark.operators.nearest import nearest

SCHEMA = "item_id long, text string, vector string"


def documents(spark, n=240, topics=6):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        words = [f"t{k % topics}w{rng.integers(12)}" for _ in range(30)] + [f"common{rng.integers(5)}" for _ in range(10)]
        rows.append((k, " ".join(words), "clash"))
    return spark.createDataFrame(rows, SCHEMA).drop("vector")


def test_axes_span_the_leading_singular_space(spark):
    corpus = documents(spark)
    encoder = latent.LatentEncoder.fit(corpus, "text", dimensions=6, buckets=256)
    lists = corpus.select(latent.word_buckets(F.col("text"), 256).alias("b")).toPandas()["b"]
    rows = latent.SparseRows(lists.to_list(), encoder.idf)
    dense = np.zeros((rows.n, 256))
    dense[rows.rows, rows.columns] = rows.values
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    right = np.linalg.svd(dense)[2][:6]
    assert np.allclose(encoder.axes.T @ encoder.axes, np.eye(6), atol=1e-8)
    assert np.allclose(np.linalg.norm(right @ encoder.axes), np.sqrt(6), atol=0.05)  # the same space
    assert np.allclose(rows.times(encoder.axes), dense @ encoder.axes)


def test_half_of_the_words_find_the_topic(spark):
    corpus = documents(spark)
    encoder = latent.LatentEncoder.fit(corpus, "text", dimensions=6, buckets=256)
    half = F.array_join(F.filter(F.split("text", " "), lambda _, i: i % 2 == 0), " ")
    as_vector = lambda df, name: encoder(df, "text").select(
        F.col("item_id").alias(name), F.col("vector").cast("array<double>").alias("vector"))
    found = nearest(as_vector(corpus.withColumn("text", half), "query_id"), as_vector(corpus, "item_id"), 5).collect()
    assert np.mean([r.query_id % 6 == r.item_id % 6 for r in found]) > 0.95


def test_encoder_edges(spark):
    corpus = documents(spark, 40)
    encoder = latent.LatentEncoder.fit(corpus, "text", dimensions=4, buckets=64)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "! a ?"), (4, "word " * 100_000), (4, "word")], "item_id long, text string")
    got = encoder(rows, "text").collect()
    norms = [float(np.linalg.norm(r.vector)) for r in sorted(got, key=lambda r: r.item_id)]
    assert norms[:3] == [0, 0, 0] and norms[3:] == norms[4:] * 2
    nobody = latent.LatentEncoder.fit(corpus.limit(0), "text", dimensions=4, buckets=64)
    assert [len(r.vector) for r in nobody(rows, "text").collect()] == [4] * 5


def test_plane_keeps_more_neighbours_than_axes(spark):
    """A ring in many dimensions with noise: axes fold it, the graph does not."""
    rng = np.random.default_rng(3)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 150))
    waves = np.stack([f(k * angle) for k in (2, 3, 4, 5) for f in (np.sin, np.cos)], axis=1)
    vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(waves)], "item_id long, vector array<double>")
    neighbours = nearest(vectors.withColumnRenamed("item_id", "query_id"), vectors, 6, exclude_self=True)
    axes = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in enumerate(waves)], "id long, x double, y double")
    near = lambda q, c, k: nearest(q, c, k, exclude_self=True)
    before = plane.kept_neighbours(axes, neighbours, near, 6).first()
    after = plane.kept_neighbours(plane.neighbour_plane(axes, neighbours, 6), neighbours, near, 6).first()
    assert before.neighbours == after.neighbours == 900 and after.kept > before.kept
    assert plane.neighbour_plane(axes.limit(0), neighbours.limit(0), 2).count() == 0
    alone = plane.neighbour_plane(axes.limit(3), neighbours.limit(0), 2).collect()
    assert len(alone) == 3 and all(np.isfinite([r.x, r.y]).all() for r in alone)
