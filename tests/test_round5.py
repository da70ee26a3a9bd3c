"""Factors by alternating least squares: Spark's own solver is the reference, shuffles stay out of the iterations."""

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from martspark.operators import alternating, recommending


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(u), int(i)) for u, i in zip(rng.integers(0, 300, 5000), 90 * rng.random(5000) ** 3)}
    pairs |= {(u, 7) for u in range(300)}  # one product that everyone has
    rows = [(u * 10 + 3, i * 7 + 1, float(rng.random() * 4 + 0.1)) for u, i in sorted(pairs)]
    rows += rows[:50] + [(3, 1, 0.0), (99_999, 1, -1.0), (3, 88_888, None), (None, 1, 2.0), (13, None, 2.0)]
    # Repeated pairs count twice, the rest not at all, but a null id has a place in the index.
    return spark.createDataFrame(rows, "user_id long, product_id long, interaction_score double")


def vectors(table, key):
    return {r[key]: np.array(r["vector"]) for r in table.collect()}


@pytest.mark.parametrize("few, block", [(20_000, 3_000_000), (200, 3_000_000), (20_000, 150)])
def test_factors_equal_those_of_sparks_solver(ratings, few, block, monkeypatch):
    monkeypatch.setattr(alternating, "FEW_RATINGS", few)
    monkeypatch.setattr(alternating, "BLOCK_RATINGS", block)
    monkeypatch.setattr(alternating, "SLAB_VALUES", 2_000)
    got = recommending.train_factors(ratings, factors=8, iterations=3)
    users, items = vectors(got.users, "user_id"), vectors(got.items, "item_id")
    kept = ratings.filter("interaction_score > 0")
    indexed = kept.join(recommending.id_index(kept, "user_id"), "user_id").join(recommending.id_index(kept, "product_id"), "product_id")
    model = ALS(rank=8, maxIter=3, regParam=recommending.REGULARISATION, implicitPrefs=True, seed=recommending.SEED,
                userCol="user_id_idx", itemCol="product_id_idx", ratingCol="interaction_score").fit(indexed)
    ids = indexed.select(F.col("user_id"), F.col("product_id"), "user_id_idx", "product_id_idx")
    for mine, factors, key in ((users, model.userFactors, "user_id"), (items, model.itemFactors, "product_id")):
        names = {r[1]: r[0] for r in ids.select(key, f"{key}_idx").distinct().collect()}
        theirs = {names[r.id]: np.array(r.features) for r in factors.collect()}
        assert mine.keys() == theirs.keys()
        assert max(abs(mine[k] - theirs[k]).max() for k in mine) < 1e-5


def test_iterations_shuffle_nothing(spark, ratings):
    """The shuffles of a fit are as many for five iterations as for one."""
    def shuffles(iterations):
        begun = spark.sparkContext._jsc.sc().newShuffleId()
        recommending.train_factors(ratings, factors=4, iterations=iterations)
        return spark.sparkContext._jsc.sc().newShuffleId() - begun

    shuffles(1)
    assert shuffles(1) == shuffles(5)
