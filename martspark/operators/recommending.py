"""Implicit-feedback recommendations: factors, evaluation, top items and their log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.functions.routing import experiment_variant
from martspark.operators.alternating import alternating_factors
from martspark.operators.nearest import nearest
from martspark.operators.profiling import sampled
from martspark.operators.ranking import global_row_number
from martspark.plans.analytics import within
from martspark.session import shared_folder, written

FACTORS, ITERATIONS, REGULARISATION, SEED = 64, 50, 0.01, 42
EVALUATED_USERS, HIT_AT = 500, 10


@dataclass
class Factors:
    """Factor tables keyed by the original ids: (user_id, vector) and (item_id, vector)."""

    users: DataFrame
    items: DataFrame

    def save(self, path: str) -> None:
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.items.write.mode("overwrite").parquet(f"{path}/items")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Factors":
        return Factors(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"))


def id_index(df: DataFrame, column: str) -> DataFrame:
    """Dense 0-based index of the distinct ids in ascending order."""
    ids = df.select(column).distinct()
    numbered = global_row_number(ids, [F.col(column)], "_n")
    return written(numbered.select(column, (F.col("_n") - 1).cast("int").alias(f"{column}_idx")), f"index-{column}")


def train_factors(
    interactions: DataFrame, factors: int = FACTORS, iterations: int = ITERATIONS, regularisation: float = REGULARISATION
) -> Factors:
    """Alternating least squares on (user_id, product_id, interaction_score).

    The solver checkpoints its iterations into the shared folder.
    """
    context = interactions.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(interactions.sparkSession))
    rated = interactions.filter(F.col("interaction_score") > 0).select("user_id", "product_id", "interaction_score")
    rated = written(rated, "ratings")
    users, items = id_index(rated, "user_id"), id_index(rated, "product_id")
    indexed = rated.join(users, "user_id").join(items, "product_id")
    of_users, of_items = alternating_factors(
        indexed, "user_id_idx", "product_id_idx", "interaction_score", factors, iterations, regularisation, SEED
    )
    back = lambda table, index, key, name: table.join(index, table["id"] == index[f"{key}_idx"]).select(
        F.col(key).alias(name), F.col("features").alias("vector")
    )
    return Factors(
        written(back(of_users, users, "user_id", "user_id"), "user-factors"),
        written(back(of_items, items, "product_id", "item_id"), "item-factors"),
    )


def best_item_per_user(interactions: DataFrame) -> DataFrame:
    """Each user's highest-scored product, the lower id on ties, without sorting a group."""
    return interactions.groupBy("user_id").agg(
        F.max_by("product_id", F.struct(F.col("interaction_score"), (-F.col("product_id")).alias("k"))).alias("product_id")
    )


def users_with_items(interactions: DataFrame, at_least: int = 2) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") >= at_least)


def held_out_pairs(interactions: DataFrame, users: int = EVALUATED_USERS, seed: int = SEED) -> DataFrame:
    """Best item of a fixed random choice of users that have at least two."""
    eligible = users_with_items(interactions).select("user_id")
    chosen = sampled(eligible, F.col("user_id"), users, seed)
    return best_item_per_user(interactions).join(chosen, "user_id", "left_semi")


def training_pairs(interactions: DataFrame, held_out: DataFrame) -> DataFrame:
    return interactions.join(held_out, ["user_id", "product_id"], "left_anti")


def recommendations(factors: Factors, users: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` items per user by cosine; bought items are not filtered out."""
    within(n, 1, 50, "n")
    queries = factors.users.join(users.select("user_id").distinct(), "user_id", "left_semi")
    found = nearest(queries.withColumnRenamed("user_id", "query_id"), factors.items, n)
    return found.withColumnsRenamed({"query_id": "user_id", "item_id": "product_id"})


def hit_rate(interactions: DataFrame, users: int = EVALUATED_USERS, k: int = HIT_AT, **training) -> DataFrame:
    """Share of evaluated users whose held-out item is among their top ``k``.

    The held-out pairs are removed before the factors are fitted, so the score
    says how well an unseen pair is found.
    """
    held_out = written(held_out_pairs(interactions, users), "held-out")
    factors = train_factors(training_pairs(interactions, held_out), **training)
    found = recommendations(factors, held_out, k).select("user_id", "product_id", F.lit(1).alias("hit"))
    return held_out.join(found, ["user_id", "product_id"], "left").agg(
        F.count(F.lit(1)).alias("users"), F.count("hit").alias("hits"),
        (F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("hit_rate"),
    )


def product_names(products: DataFrame) -> DataFrame:
    """One name and department per product."""
    first = F.min(F.struct("product_name", "department")).alias("p")
    return products.groupBy("product_id").agg(first).select("product_id", "p.*")


def with_product_names(items: DataFrame, products: DataFrame) -> DataFrame:
    """Name and department of each item, ``Unknown`` where the product is missing."""
    return items.join(product_names(products), "product_id", "left").withColumns(
        {c: F.coalesce(c, F.lit("Unknown")) for c in ("product_name", "department")}
    )


def recommend(factors: Factors, users: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """Ranked items with names and the user's experiment variant; unknown users yield an error row."""
    ranked = with_product_names(recommendations(factors, users, n), products)
    return users.select("user_id").distinct().join(ranked, "user_id", "left").select(
        "user_id", experiment_variant(F.col("user_id")).alias("variant"), "position", "product_id", "product_name",
        "department", "similarity",
        F.when(F.col("product_id").isNull(), "no factors for this user").alias("error"),
    )


def impressions(recommended: DataFrame) -> DataFrame:
    """One log row per served user."""
    return recommended.filter(F.col("error").isNull()).groupBy("user_id", "variant").agg(
        F.count(F.lit(1)).cast("int").alias("items_shown")
    )


def similar_items(items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar other items of every item."""
    return nearest(items.withColumnRenamed("item_id", "query_id"), items, k, exclude_self=True)


def projection(items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Item vectors on their two main axes, with product attributes where known."""
    vectors = items.select("item_id", array_to_vector(F.col("vector")).alias("v"))
    axes = vector_to_array(F.col("xy"))
    flat = PCA(k=2, inputCol="v", outputCol="xy").fit(vectors).transform(vectors).select(
        F.col("item_id").alias("product_id"), axes[0].alias("axis_1"), axes[1].alias("axis_2")
    )
    if products is None:
        return flat
    return flat.join(product_names(products), "product_id", "left")


def highlighted_points(points: DataFrame, recommended: DataFrame, n: int = 6_000, seed: int = SEED) -> DataFrame:
    """A background sample without the recommended items, and all recommended items once."""
    ids = recommended.select("product_id").distinct()
    sample = sampled(points, F.col("product_id"), n, seed)
    inside = lambda df: df.join(ids, "product_id", "left_semi")
    top = inside(sample).union(inside(points)).dropDuplicates().withColumn("highlighted", F.lit(True))
    return sample.join(ids, "product_id", "left_anti").withColumn("highlighted", F.lit(False)).unionByName(top)

