"""Mixing sources to target weights: iterative proportional fitting and sampling by calibrated probabilities.

Token weights of the cells (source, language, topic) are raked until the sums per
source, per language and per topic meet their target shares. A document is then
kept with a probability proportional to its cell's factor, scaled so that the
largest probability is one: the expected token shares of the sample are the
targets, and the decision is a hash of the document, the same on every run.

Topics come from ``k``-means over hashed word counts, less the mean of the
document's language, so that a topic is not just a language again. Means and
centres are fitted on all documents that have words, a copy counting like any other
document; a document is assigned by its whole text. Tokens are the words of the text.

Cells are aggregated before any shuffle, so a source with most of the rows is one
row per topic and language. Raking runs as groupings and joins over the cell table;
each round's table is written, so a lost executor costs one round.

Defined results: a missing source or language counts as the empty name; a document
without words has no tokens, the first topic, and is kept by its cell's factor; a
cell without tokens has factor one; fewer than ``2 k`` documents with
words give one topic; targets without data are left out and the
others scaled up; equal rows get equal decisions; an empty table gives an empty
result. Other columns are carried through or left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.llm.common import ROW, batches, packed, unpacked
from martspark.session import written

TOPICS = 8
TOPIC_SLOTS = 256
SMOOTHING = 0.9  # default targets: a value's share of tokens to this power
TOLERANCE = 1e-3
MAX_ROUNDS = 40
BROADCAST_LANGUAGES = 10_000  # a language mean takes 2 KB, so this many are 20 MB
BROADCAST_CELLS = 100_000  # a cell takes under 200 bytes, so this many are under 20 MB
SEED = 7

MARGINS = ("source", "lang", "topic")


def word_counts(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and how many of them fall into each of ``TOPIC_SLOTS`` hash slots."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0, np.zeros(TOPIC_SLOTS)
    distinct, times = np.unique(np.array(words, dtype=object), return_counts=True) if len(words) > 1 << 20 else (words, None)
    slots = np.fromiter(map(xxhash.xxh32_intdigest, distinct), np.int64, len(distinct)) & (TOPIC_SLOTS - 1)
    return len(words), np.bincount(slots, weights=times, minlength=TOPIC_SLOTS).astype(float)


@dataclass
class Topics:
    """Topic centres, and ``lang, offsets``: a language's number per centre to take from a vector's product with it.

    For a vector less its language's mean the nearest centre is the one of the largest
    ``centre * vector - (centre * mean + centre ** 2 / 2)``. No offsets: one topic.
    """

    centres: np.ndarray
    offsets: DataFrame | None = None


def fit_topics(docs: DataFrame, k: int = TOPICS) -> Topics:
    """Topics of ``docs(text, lang)``, fitted on all documents that have words."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = [word_counts(t.as_py()) for t in frame.column(0)]
            counts = np.concatenate([c for _, c in found])
            yield pa.record_batch([pa.ListArray.from_arrays(np.arange(len(found) + 1) * TOPIC_SLOTS, pa.array(counts.astype(np.int32))),
                                   pa.array([float(np.linalg.norm(c)) for _, c in found], pa.float64()), frame.column(1)],
                                  names=["counts", "norm", "lang"])

    # Whole counts take a small part of the text's size on disk; unit vectors are made from them as they are read.
    points = written(docs.select("text", "lang").mapInArrow(count, "counts array<int>, norm double, lang string")
                     .filter("norm > 0"), "word-counts")
    if len(points.limit(2 * k).collect()) < 2 * k:  # too few to tell topics apart
        return Topics(np.zeros((1, TOPIC_SLOTS)))
    points = points.select("lang", F.transform("counts", lambda n: n / F.col("norm")).alias("v"))
    means = written(points.groupBy("lang").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean")), "language-means")
    centred = points.join(_small(means), "lang").select(
        array_to_vector(F.zip_with("v", "mean", lambda a, b: a - b)).alias("features"))
    centres = np.array(KMeans(k=k, seed=SEED, maxIter=10).fit(centred).clusterCenters())

    def offset(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = [(centres @ np.array(m) + (centres ** 2).sum(1) / 2).tolist() for m in frame.column(1).to_pylist()]
            yield pa.record_batch([frame.column(0), pa.array(found, pa.list_(pa.float64()))], names=["lang", "offsets"])

    return Topics(centres, written(means.mapInArrow(offset, "lang string, offsets array<double>"), "topic-offsets"))


def _small(languages: DataFrame) -> DataFrame:
    """A table with a row per language, broadcast unless there are too many of them."""
    return F.broadcast(languages) if languages.count() <= BROADCAST_LANGUAGES else languages


def with_topics(rows: DataFrame, topics: Topics) -> DataFrame:
    """Add ``topic`` and ``n_tokens`` to rows with ``lang`` and ``text``; the text is left out."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("topic", T.LongType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in kept]
    centres = topics.centres
    if topics.offsets is None:
        rows = rows.withColumn("_offsets", F.lit(None).cast("array<double>"))
    else:
        rows = rows.join(_small(topics.offsets.withColumnRenamed("offsets", "_offsets")), "lang", "left")

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = [word_counts(t.as_py()) for t in frame.column("text")]
            offsets = frame.column("_offsets").to_pylist()
            places = [int(np.argmax(centres @ (c / np.linalg.norm(c)) - of)) if n and of else 0 for (n, c), of in zip(found, offsets)]
            columns = [frame.column(name) for name in names]
            yield pa.record_batch([*columns, pa.array(places, pa.int64()), pa.array([n for n, _ in found], pa.int64())],
                                  names=[*names, "topic", "n_tokens"])

    return rows.mapInArrow(assign, schema)


def smoothed_targets(cells: DataFrame, margin: str, power: float = SMOOTHING) -> DataFrame:
    """Default targets: token shares of a margin's values, evened out by a power."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    return sums.select(margin, F.pow("tokens", F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``source, lang, topic, tokens, weight``: cell weights whose margins meet the targets.

    ``targets[margin]`` holds ``margin, share``; shares need not sum to one. Weights
    sum to the number of tokens. A round adjusts each margin in turn; raking ends
    when no adjustment exceeds ``TOLERANCE``, or when a whole round leaves every
    weight as it was (targets that the cells cannot meet together).
    """
    live = written(cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double")), "cells")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return live
    placed = live
    for margin in MARGINS:
        given = (targets or {}).get(margin)
        shares = smoothed_targets(live, margin) if given is None else given.filter("share > 0").join(
            live.select(margin).distinct(), margin)
        whole = shares.agg(F.sum("share").alias("whole"))
        wanted = shares.join(F.broadcast(whole)).select(
            margin, (F.col("share") / F.col("whole") * total).alias(f"target_{margin}"))
        placed = placed.join(wanted, margin, "left")
    live = written(placed, "raked")
    for _ in range(MAX_ROUNDS):
        step = live.withColumns({"gap": F.lit(0.0), "before": F.col("weight")})
        for margin in MARGINS:
            sums = step.groupBy(margin).agg(F.sum("weight").alias("now"))
            ratio = F.coalesce(F.col(f"target_{margin}") / F.nullif("now", F.lit(0.0)), F.lit(0.0))
            step = step.join(sums, margin).withColumns({
                "weight": F.col("weight") * ratio,
                "gap": F.greatest("gap", F.when(F.col("weight") > 0, F.abs(ratio - 1)).otherwise(F.lit(0.0)))}).drop("now")
        done = written(step, "raked")
        live = done.drop("gap", "before")
        moved = F.abs(F.col("weight") - F.col("before")) / F.greatest("weight", "before", F.lit(1e-9))
        gap, change = done.agg(F.max("gap"), F.max(moved)).first()
        if gap < TOLERANCE or change < TOLERANCE / 10:
            break
    return live.drop(*(f"target_{margin}" for margin in MARGINS))


def calibrated(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with their ``factor`` (weight per token) and ``probability``."""
    raked = rake(cells, targets).select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("factor"))
    top = raked.agg(F.max("factor").alias("top"))
    return written(raked.join(F.broadcast(top)).select(
        *MARGINS, "factor", (F.col("factor") / F.col("top")).alias("probability")), "calibrated")


def _names(docs: DataFrame) -> dict:
    return {"text": F.col("text").cast("string"), "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "lang": F.coalesce(F.col("lang").cast("string"), F.lit(""))}


def _decided(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with ``pick`` and their cell's probability; a cell without tokens counts as factor one."""
    if chosen.count() <= BROADCAST_CELLS:
        chosen = F.broadcast(chosen)  # beyond that a plain join, whose skewed cells Spark splits at run time
    draw = F.shiftrightunsigned("pick", 11) / F.lit(float(1 << 53))
    rows = rows.join(chosen, list(MARGINS), "left")
    return rows.withColumns({"factor": F.coalesce("factor", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0)),
                             }).withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, k: int = TOPICS) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, factor, probability, kept`` per row of ``docs``."""
    names = _names(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("doc_id", "text", F.lit(SEED)).alias("pick"), *(c.alias(n) for n, c in names.items()))
    topics = fit_topics(docs.select(names["text"].alias("text"), names["lang"].alias("lang")), k)
    rows = written(with_topics(rows, topics), "topics")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    return _decided(rows, calibrated(cells, targets)).select(
        "doc_id", *MARGINS, "n_tokens", "factor", "probability", "kept")


def sample_mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, k: int = TOPICS) -> DataFrame:
    """The kept rows with their own columns; texts are read twice and never shuffled for a bounded cell table."""
    names = _names(docs)
    texts = docs.select(*(c.alias(n) for n, c in names.items()))
    topics = fit_topics(texts, k)
    narrow = with_topics(texts, topics)
    cells = written(narrow.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    rows = with_topics(packed(docs, pick=F.xxhash64("doc_id", "text", F.lit(SEED)), **names), topics)
    return unpacked(_decided(rows, calibrated(cells, targets)).filter("kept").select(ROW), docs.columns)
