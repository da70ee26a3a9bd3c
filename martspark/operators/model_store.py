"""Versioned models in folders, with a log of the parameters and metrics of every run.

A model lies in ``<root>/<experiment>/v<number>-<id>``; the log is an append-only table with a
row per saved model. The champion of an experiment is a row of its own that is appended
last and names a version that exists, so a reader sees either the old champion or the new
one, never half of one. Two writers may get the same number; the id keeps their folders apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = ("experiment string, version int, run_id string, kind string, name string, logged_at timestamp, "
       "params map<string,string>, metrics map<string,double>, path string")
MODEL, CHAMPION = "model", "champion"


@dataclass(frozen=True)
class Saved:
    """Where a run's model lies."""

    experiment: str
    version: int
    run_id: str
    path: str


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, saved: Saved, kind: str, name: str, params: dict, metrics: dict) -> None:
        row = (saved.experiment, saved.version, saved.run_id, kind, name, None, {k: str(v) for k, v in params.items()},
               {k: float(v) for k, v in metrics.items()}, saved.path)
        self.spark.createDataFrame([row], LOG).withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode(
            "append").parquet(f"{self.root}/log")

    def log(self) -> DataFrame:
        """All rows of the log; none before the first run."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except Exception as error:  # the only reader error that means an empty log
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], LOG)

    def save(self, experiment: str, name: str, write, params: dict, metrics: dict) -> Saved:
        """Let ``write(path)`` save a model in a new version's folder, then log it."""
        newest = self.log().filter(F.col("experiment") == experiment).agg(F.max("version")).first()[0] or 0
        run_id = uuid.uuid4().hex
        saved = Saved(experiment, newest + 1, run_id, f"{self.root}/{experiment}/v{newest + 1:05d}-{run_id[:8]}")
        write(saved.path)
        self._append(saved, MODEL, name, params, metrics)
        return saved

    def promote(self, experiment: str, metric: str) -> Saved:
        """Append the model with the smallest metric as champion; equal ones: the older."""
        best = self.log().filter((F.col("experiment") == experiment) & (F.col("kind") == MODEL)).withColumn(
            "_m", F.col("metrics")[metric]).filter("_m is not null and not isnan(_m)").orderBy("_m", "version", "run_id").first()
        if best is None:
            raise ValueError(f"no run of {experiment!r} has the metric {metric!r}")
        saved = Saved(experiment, best.version, best.run_id, best.path)
        self._append(saved, CHAMPION, best["name"], best.params, best.metrics)
        return saved

    def champion(self, experiment: str) -> Saved:
        """The champion that was appended last."""
        last = self.log().filter((F.col("experiment") == experiment) & (F.col("kind") == CHAMPION)).orderBy(
            F.desc("logged_at"), F.desc("version")).first()
        if last is None:
            raise ValueError(f"{experiment!r} has no champion")
        return Saved(experiment, last.version, last.run_id, last.path)
