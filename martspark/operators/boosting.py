"""Boosted regression trees for demand: Newton steps of the Tweedie deviance on a log link.

Each round fits one tree of ``pyspark.ml`` to the step that the deviance asks for: its target
is minus the first derivative over the second, its weight the second derivative, so a leaf's
value is the Newton step of its rows. Category codes are nominal inputs: a tree splits them
into two sets of labels, with a bin per label. A category with more than ``MAX_LABELS`` labels
enters as the rank of its code instead, since a bin per label would not fit the histograms.

The fitted trees leave Spark as a small table of nodes (at most ``rounds * 2 ** (depth + 1)``
rows) and are evaluated for whole batches of rows. The same walk attributes a prediction to
inputs: at every split the change of the node's mean goes to the input that was asked, so the
parts of a row add up to its margin minus the base, whatever the trees look like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.operators.features import CATEGORIES, encoded, feature_columns
from martspark.session import working_path, written

VARIANCE_POWER = 1.5
ROUNDS, DEPTH, STEP = 40, 5, 0.15
MIN_ROWS_PER_LEAF = 20
MAX_LABELS = 1024
ROUNDS_PER_WRITE = 6
NODES = ("tree int, node int, feature int, threshold double, categories array<double>, left int, right int, value double")


def nominal(column: str, n_labels: int):
    """A code column that tree learners take as labels; code 0 stands for a label that was not fitted."""
    shifted = (F.col(column) + 1).cast("double")
    if n_labels + 1 > MAX_LABELS:
        return shifted.alias(column)
    return shifted.alias(column, metadata={"ml_attr": {"type": "nominal", "num_vals": n_labels + 1, "name": column}})


@dataclass
class BoostedDemand:
    """Nodes of all trees, the base margin and the order of the inputs."""

    inputs: list[str]
    base: float
    step: float
    nodes: list[tuple]  # rows of NODES
    codes: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        self.trees = []
        for tree in sorted({row[0] for row in self.nodes}):
            own = sorted(row for row in self.nodes if row[0] == tree)
            labels = max([int(c) for row in own for c in row[4] or []], default=0) + 1
            left = np.zeros((len(own), labels), bool)
            for k, row in enumerate(own):
                left[k, [int(c) for c in row[4] or []]] = True
            self.trees.append({
                "feature": np.array([row[2] for row in own]), "threshold": np.array([row[3] for row in own]),
                "by_label": np.array([row[4] is not None for row in own]), "labels": left,
                "left": np.array([row[5] for row in own]), "right": np.array([row[6] for row in own]),
                "value": np.array([row[7] for row in own])})

    def _children(self, tree: dict, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next node of each row; a leaf stays."""
        feature = tree["feature"][at]
        value = x[np.arange(len(x)), np.maximum(feature, 0)]
        label = np.clip(value.astype(int), 0, tree["labels"].shape[1] - 1)
        in_labels = tree["labels"][at, label] & (value < tree["labels"].shape[1])
        goes_left = np.where(tree["by_label"][at], in_labels, value <= tree["threshold"][at])
        return np.where(feature < 0, at, np.where(goes_left, tree["left"][at], tree["right"][at]))

    def attributed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the rows of ``x`` and the part of each input in them."""
        parts, margin = np.zeros(x.shape), np.full(len(x), self.expected)
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            while True:
                following = self._children(tree, x, at)
                if (following == at).all():
                    break
                change = self.step * (tree["value"][following] - tree["value"][at])
                np.add.at(parts, (rows, np.maximum(tree["feature"][at], 0)), change)
                at = following
            margin += self.step * (tree["value"][at] - tree["value"][0])
        return margin, parts

    @property
    def expected(self) -> float:
        """The margin before any input is known: base and the means at the roots."""
        return self.base + self.step * sum(tree["value"][0] for tree in self.trees)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            while True:
                following = self._children(tree, x, at)
                if (following == at).all():
                    break
                at = following
            total += self.step * tree["value"][at]
        return total

    def coded(self, features: DataFrame) -> DataFrame:
        """Features with label codes, unless they carry them already."""
        return encoded(features, {c: table for c, table in self.codes.items() if f"{c}_code" not in features.columns})

    def ready(self, features: DataFrame) -> DataFrame:
        """Features with the codes and the inputs as doubles; codes are moved up by one."""
        return self.coded(features).withColumn("_x", F.array(*(
            F.coalesce((F.col(c) + 1 if c.endswith("_code") else F.col(c)).cast("double"), F.lit(0.0)) for c in self.inputs)))

    def predict(self, features: DataFrame) -> DataFrame:
        """The features with ``prediction``, in the order of their partitions."""
        ready = self.ready(features)
        kept = ready.columns[:-1]

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
        model = self.without_codes()

        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.stack(frame["_x"].to_numpy()) if len(frame) else np.zeros((0, len(model.inputs)))
                yield frame[kept].assign(prediction=np.exp(model.margin(x)))

        return ready.mapInPandas(scored, f"{types}, prediction double")

    def predictor(self) -> "BoostedDemand":
        """What a forecast calls with a matrix of inputs."""
        return self.without_codes()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Predictions for inputs whose codes begin at 0, as the linear model takes them."""
        moved = np.array([c.endswith("_code") for c in self.inputs], dtype=float)
        return np.exp(np.clip(self.margin(x + moved), -50.0, 50.0))

    def without_codes(self) -> "BoostedDemand":
        """The model without tables of the session, as tasks need it."""
        return BoostedDemand(self.inputs, self.base, self.step, self.nodes)

    def attributions(self, features: DataFrame) -> DataFrame:
        """Per input: rows, mean absolute part, mean part, and the largest gap between a row's parts and its margin.

        A task sums its own rows; what is shuffled is a row per task and input.
        """
        model = self.without_codes()

        def attribute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, size, signed, gap = 0, np.zeros(len(model.inputs)), np.zeros(len(model.inputs)), 0.0
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["_x"].to_numpy())
                    margin, parts = model.attributed(x)
                    n += len(x)
                    size += np.abs(parts).sum(axis=0)
                    signed += parts.sum(axis=0)
                    gap = max(gap, float(np.abs(parts.sum(axis=1) + model.expected - model.margin(x)).max()))
            if n:
                yield pd.DataFrame({"feature": model.inputs, "rows": n, "size": size, "signed": signed, "gap": gap})

        sums = self.ready(features).select("_x").mapInPandas(
            attribute, "feature string, rows long, size double, signed double, gap double")
        return sums.groupBy("feature").agg(
            F.sum("rows").alias("rows"), (F.sum("size") / F.sum("rows")).alias("mean_size"),
            (F.sum("signed") / F.sum("rows")).alias("mean_part"), F.max("gap").alias("largest_gap"))

    # -------------------------------------------------------------------- files

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.base, self.step, self.inputs)], "base double, step double, inputs array<string>").coalesce(
            1).write.parquet(f"{path}/settings")
        for column, table in self.codes.items():
            table.write.parquet(f"{path}/codes/{column}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedDemand":
        settings = spark.read.parquet(f"{path}/settings").first()
        nodes = [tuple(row) for row in spark.read.parquet(f"{path}/nodes").collect()]
        codes = {c: spark.read.parquet(f"{path}/codes/{c}") for c in CATEGORIES}
        return BoostedDemand(list(settings.inputs), settings.base, settings.step, nodes, codes)


def exported_nodes(spark: SparkSession, model, tree: int) -> list[tuple]:
    """Rows of NODES of one fitted tree; nodes are numbered from 0, the root."""
    path = working_path(spark, "tree")
    model.write().save(path)
    rows = sorted(spark.read.parquet(f"{path}/data").collect(), key=lambda row: row["id"])
    at = {row["id"]: k for k, row in enumerate(rows)}
    found = []
    for row in rows:
        split = row["split"]
        if row["leftChild"] < 0:
            found.append((tree, at[row["id"]], -1, 0.0, None, at[row["id"]], at[row["id"]], row["prediction"]))
            continue
        by_label = split["numCategories"] >= 0
        values = list(split["leftCategoriesOrThreshold"])
        found.append((tree, at[row["id"]], split["featureIndex"], 0.0 if by_label else values[0], values if by_label else None,
                      at[row["leftChild"]], at[row["rightChild"]], row["prediction"]))
    return found


def boosting_inputs(features: DataFrame) -> list[str]:
    plain = [c for c in feature_columns(features) if not c.endswith("_code")]
    return [f"{c}_code" if c in CATEGORIES else c for c in plain]


def fit_boosted(train: DataFrame, codes: dict[str, DataFrame], rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP,
                power: float = VARIANCE_POWER) -> BoostedDemand:
    """Fit on ``train``, whose columns are the features, ``unit_sales`` and possibly the codes.

    A pass per level and round reads the written rows; every few rounds the margins are
    written, so a lost executor costs a few rounds of a pass and no plan grows.
    """
    spark = train.sparkSession
    inputs = boosting_inputs(train)
    coded = encoded(train, {c: table for c, table in codes.items() if f"{c}_code" not in train.columns})
    labels = {f"{c}_code": table.count() for c, table in codes.items()}
    columns = [nominal(c, labels[c]) if c in labels else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in inputs]
    prepared = coded.select(*columns, F.col("unit_sales").cast("double").alias("y"))
    mean = prepared.agg(F.avg("y")).first()[0] or 0.0
    base = float(np.log(max(mean, 1e-6)))
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(prepared)
    metadata = assembled.schema["features"].metadata
    rows = written(assembled.select("features", "y", F.lit(base).alias("margin")), "boosting-rows")
    bins = max([32, *(n + 1 for n in labels.values() if n + 1 <= MAX_LABELS)])
    nodes: list[tuple] = []
    for k in range(rounds):
        # Derivatives of the deviance by the margin; the second is positive for powers between 1 and 2.
        left, right = F.exp((1 - power) * F.col("margin")), F.exp((2 - power) * F.col("margin"))
        first, second = right - F.col("y") * left, (2 - power) * right + (power - 1) * F.col("y") * left
        learner = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="weight", predictionCol="move",
                                        maxDepth=depth, maxBins=bins, minInstancesPerNode=MIN_ROWS_PER_LEAF, seed=k)
        asked = rows.select(F.col("features").alias("features", metadata=metadata), "y", "margin",
                            (-first / second).alias("target"), second.alias("weight"))
        tree = learner.fit(asked)
        nodes += exported_nodes(spark, tree, k)
        rows = tree.transform(rows).select("features", "y", (F.col("margin") + step * F.col("move")).alias("margin"))
        if (k + 1) % ROUNDS_PER_WRITE == 0:
            rows = written(rows, "boosting-rows")
    return BoostedDemand(inputs, base, step, nodes, codes)
