"""Filter interaction audit: what each order of the filters removes, from decision diagrams of failure masks.

The corpus is reduced once to counts per part and failure mask, one bit per filter.
Per part those counts make a count-weighted decision diagram: a level per filter, two
edges per node (pass and fail), and at the leaves the numbers of documents. Every node
knows the sum below it. Two neighbouring filters change places by swapping two levels,
which touches only the nodes of the upper one; a walk through all orders by such swaps
visits each order once. In the diagram of an order the path of pass edges from the root
shows the steps: what hangs on the fail edge of a level is what its filter removes.

A part has at most ``2 ** filters`` masks, whatever the number of documents, so a
diagram is small and parts are spread over tasks. Masks are counted before the shuffle.
Exact copies are found by a 128-bit digest: rows are first combined per digest and
part, so that a group of copies sends a few rows, whatever its size.

Defined results: a missing text is empty; a missing source is the part of the empty
name; rows with one document id are documents of their own, and copies under the same id
are not copies of a *smaller* one; a row without an id is never a copy and makes no other
row one. A document that several label rows name is good or toxic if one of them says so;
without a label it is neither. Other columns are not read, whatever their names. An empty
table gives no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import WORD

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOL = r"[#$%&*|]"
FILTERS = "ABCDE"

STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D of a text, which depend on nothing else."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
            100 * capitals > MAX_CAPITALS_PERCENT * F.length(text),
            text.rlike(SYMBOL)]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and failure mask (bit k: filter k fails)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_failures(text))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.md5(text)).alias("digest"), bits.alias("mask"))
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(judged, "doc_id", "left").fillna(0, ["good", "toxic"])
    ids = rows.groupBy("digest", "part", "mask", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    first = F.min_by("n", "doc_id")  # rows of the group's smallest id; ids are unique here
    groups = ids.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), first.alias("n_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without_id"))
    lowest = groups.groupBy("digest").agg(F.min("low").alias("lowest"))
    originals = F.coalesce(F.when(F.col("low") == F.col("lowest"), F.col("n_low")), F.lit(0)) + F.col("n_without_id")
    split = groups.join(lowest, "digest").select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), originals.alias("n")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - originals).alias("n")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


class Diagram:
    """Count-weighted decision diagram over ``n`` filters, whose levels can be swapped.

    Nodes are ``(pass, fail)`` pairs of node numbers, kept once per level, and leaves are kept
    once per count vector; node 0 is the empty one. ``weights[k]`` is the count vector of all documents below node ``k``.
    """

    def __init__(self, n: int, weights: dict[int, tuple[int, ...]]):
        self.n, self.order = n, list(range(n))
        width = len(next(iter(weights.values()), (0,)))
        self.children: list[tuple[int, int] | None] = [None]
        self.weights: list[tuple[int, ...]] = [(0,) * width]
        self.known: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        shared: dict[tuple[int, ...], int] = {}
        for weight in map(tuple, weights.values()):
            if any(weight) and weight not in shared:
                shared[weight] = len(self.children)
                self.children.append(None)
                self.weights.append(weight)
        leaves = {mask: shared.get(tuple(weight), 0) for mask, weight in weights.items()}
        self.root = self._built(0, 0, leaves)

    def _built(self, level: int, mask: int, leaves: dict[int, int]) -> int:
        if level == self.n:
            return leaves.get(mask, 0)
        bit = 1 << self.order[level]
        return self._node(level, self._built(level + 1, mask, leaves), self._built(level + 1, mask | bit, leaves))

    def _node(self, level: int, passed: int, failed: int) -> int:
        """The node of a level with these children; an empty one if both are empty."""
        if not passed and not failed:
            return 0
        found = self.known[level].get((passed, failed))
        if found is None:
            found = self.known[level][passed, failed] = len(self.children)
            self.children.append((passed, failed))
            self.weights.append(tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed])))
        return found

    def swap(self, level: int) -> None:
        """Let the filters of ``level`` and the next one change places.

        Only nodes of these two levels are made anew. Nodes above the upper one keep their
        numbers because its nodes do; the sums of all nodes that stay are the same.
        """
        upper, self.known[level], self.known[level + 1] = self.known[level], {}, {}
        for (passed, failed), number in upper.items():
            pp, pf = self.children[passed] or (0, 0)
            fp, ff = self.children[failed] or (0, 0)
            pair = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.children[number] = pair
            self.known[level][pair] = number
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Weights that pass and that are removed at each level of the all-pass path."""
        found, node = [], self.root
        for _ in range(self.n):
            passed, failed = self.children[node] or (0, 0)
            found.append((self.weights[passed], self.weights[failed]))
            node = passed
        return found


def adjacent_swaps(n: int) -> list[int]:
    """Levels to swap, one after the other, so that all orders of ``n`` filters are met once.

    The last element sweeps through the others from one end to the other and back; between
    two sweeps the others make their own next swap.
    """
    if n < 2:
        return []
    inner = adjacent_swaps(n - 1)
    found: list[int] = []
    for k in range(len(inner) + 1):
        found += range(n - 2, -1, -1) if k % 2 == 0 else range(n - 1)
        if k < len(inner):
            # While the sweeping element stands at the front the others are one place further down.
            found.append(inner[k] + 1 if k % 2 == 0 else inner[k])
    return found


def audited(weights: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[dict]:
    """One row per order and step for a part's ``mask: (documents, good, toxic)``."""
    n = len(filters)
    diagram = Diagram(n, weights)
    walks = {tuple(diagram.order): diagram.steps()}
    for level in adjacent_swaps(n):
        diagram.swap(level)
        walks[tuple(diagram.order)] = diagram.steps()
    failing, alone, shares = [0] * n, [0] * n, [0] * n
    for order, steps in walks.items():
        failing[order[0]] = steps[0][1][0]
        alone[order[-1]] = steps[-1][1][0]
        for which, (_, removed) in zip(order, steps):
            shares[which] += removed[0]
    return [
        {"filter_order": "".join(filters[k] for k in order), "step": at + 1, "kept": passed[0], "removed": removed[0],
         "redundant": failing[which] - removed[0], "unique_fails": alone[which], "good_lost": removed[1],
         "toxic_lost": removed[2], "shapley": shares[which]}
        for order in permutations(range(n))
        for at, (which, (passed, removed)) in enumerate(zip(order, walks[order]))
    ]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: what is kept, removed and lost.

    ``docs`` have ``doc_id, text, source``, ``labels`` have ``doc_id, quality, toxic``.
    """
    masks = failure_masks(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most one entry per mask

    def audit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in STEPS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 3)]
        schema = pa.schema(list(zip(names, types)))
        for frame in frames:
            for part in frame.to_pylist():
                weights = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in part["masks"]}
                yield pa.RecordBatch.from_pylist([{"part": part["part"], **row} for row in audited(weights)], schema=schema)

    return masks.mapInArrow(audit, STEPS)
