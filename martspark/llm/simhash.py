"""SimHash near-duplicates through a segment-popcount embedding and a grid range-join.

Fingerprints are 64 bits. Each is mapped to the vector of bit counts of its 32
two-bit segments; flipping one bit moves one coordinate by one, so the Manhattan
distance of two vectors never exceeds the Hamming distance of the fingerprints.

The join uses that lower bound on a grid. A distance of at most ``max_bits`` leaves
at least one half of the fingerprint with at most ``max_bits // 2`` differing bits,
so it is enough to find, for each half, the vectors within that radius: a
fingerprint lies in the cell of its own 16 coordinates and looks into the cells
that can be reached by raising or lowering coordinates. Candidates must then keep
to ``max_bits`` in the Manhattan distance of the whole vector, and last of all the
bits themselves are compared.

Exact copies meet before the join: it runs over distinct fingerprints, each with
its smallest document. Links between distinct fingerprints are bounded by the ball
of radius ``max_bits``, so no group of copies, however large, gives all its pairs.
Components are found over the links by joins (``components``).

Defined results: a missing or empty text, or one without words, has fingerprint
zero and is linked like any other; a text shorter than a shingle is one shingle;
a document without id gets a fingerprint and its group's smallest id, which is
null if nobody in the group has one; repeated rows are kept, each with the same
result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import packed, unpacked
from martspark.llm.components import components
from martspark.session import written

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCK_SHINGLES = 1 << 16


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles with repeats: A-Z in lower case, words apart at space and ASCII controls 9 to 13."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(group) for group in zip(*(words[k:] for k in range(size)))]


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit integer."""
    import xxhash

    items = shingles(text, size)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(items), BLOCK_SHINGLES):  # a long text takes memory for one block of bits only
        block = items[at:at + BLOCK_SHINGLES]
        hashes = np.fromiter((xxhash.xxh64_intdigest(item, HASH_SEED) for item in block), np.uint64, len(block))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(items)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""

    def compute(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = [fingerprint(text.as_py(), size) for text in frame.column(2)]
            yield pa.record_batch([frame.column(0), frame.column(1), pa.array(values, pa.int64())],
                                  names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def segment_counts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit half, two bits a coordinate."""
    low = F.lit(0x55555555)
    return half.bitwiseAND(low) + F.shiftrightunsigned(half, 1).bitwiseAND(low)


def _moves(cell: Column, steps: int) -> Column:
    """The cells within Manhattan distance ``steps`` of ``cell``, itself included.

    A set top bit of a coordinate means two, a set low bit one; coordinates stay
    within zero and two.
    """
    reached = F.array(cell)
    for _ in range(steps):
        def around(c: Column) -> Column:
            near = [c]
            for k in range(16):
                value = F.shiftrightunsigned(c, 2 * k).bitwiseAND(F.lit(3))
                near += [F.when(value < 2, c + F.lit(1 << 2 * k)), F.when(value > 0, c - F.lit(1 << 2 * k))]
            return F.array_compact(F.array(*near))

        reached = F.array_distinct(F.flatten(F.transform(reached, around)))
    return reached


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the 32 two-bit-segment counts of two fingerprints.

    Per segment the bits that only one side has are ``x = a & ~b`` and ``y = b & ~a``;
    the counts differ by the difference of their bit counts.
    """
    total = F.lit(0)
    for half in (F.lit(0), F.lit(32)):
        x = segment_counts(_half(a.bitwiseAND(F.bitwise_not(b)), half))
        y = segment_counts(_half(b.bitwiseAND(F.bitwise_not(a)), half))
        # A segment has at most two bits: x and y are (0..2, 0), (0, 0..2) or (1, 1), and (1, 1) counts nothing.
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x55555555))) + 2 * F.bit_count(
            x.bitwiseAND(F.lit(0xAAAAAAAA))) + F.bit_count(y.bitwiseAND(F.lit(0x55555555))) + 2 * F.bit_count(
            y.bitwiseAND(F.lit(0xAAAAAAAA))) - 2 * F.bit_count(x.bitwiseAND(y))
    return total


def _half(value: Column, start: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, start).bitwiseAND(F.lit(0xFFFFFFFF))


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (``a < b``): all pairs of distinct fingerprints (column ``fp``) at ``max_bits`` bits or fewer."""
    steps = max_bits // 2

    def cells(column: str, reach: int) -> DataFrame:
        halves = F.array(*(
            F.struct(F.lit(k).alias("half"), _moves(segment_counts(_half(F.col("fp"), F.lit(32 * k))), reach).alias("near"))
            for k in (0, 1)))
        spread = distinct.select("fp", F.explode(halves).alias("h"))
        return spread.select(F.col("fp").alias(column), F.col("h.half").alias("half"), F.explode("h.near").alias("cell"))

    probes, homes = cells("a", steps), cells("b", 0)
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = probes.join(homes, ["half", "cell"]).filter(
        (F.col("a") < F.col("b")) & (_manhattan(F.col("a"), F.col("b")) <= max_bits) & (bits <= max_bits))
    return near.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, fingerprint, component_id, n_rows, is_kept``.

    ``component_id`` is the smallest id reachable over links; ``n_rows`` counts the
    rows of the same fingerprint; ``text_hash`` and ``is_kept`` mark the one
    document (id and text) that stands for the component.
    """
    rows, classes = _classes(docs, size, max_bits)
    marked = rows.join(classes, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_rows",
                         kept.alias("is_kept"))


def _classes(docs: DataFrame, size: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and per distinct fingerprint its component and the document that stands for it."""
    rows = written(fingerprints(docs, size), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n_rows")), "classes")
    roots = components(fingerprint_links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leaders = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    return rows, rooted.join(leaders, "root").select(
        "fp", F.col("keeper.doc_id").alias("component_id"), "n_rows", "keeper")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest id (rows without id last, ties by text hash).

    Rows that repeat both id and text count as one document; one of them stays.
    """
    _, classes = _classes(docs, size, max_bits)
    keys = ["k_id", "k_null", "k_text"]
    keepers = classes.select("keeper").distinct().select(
        F.coalesce("keeper.doc_id", F.lit(0)).alias("k_id"), F.col("keeper.no_id").alias("k_null"),
        F.col("keeper.text_hash").alias("k_text"))
    rows = packed(docs, k_id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), k_null=F.col("doc_id").isNull(),
                  k_text=F.xxhash64("text"))
    return unpacked(rows.join(keepers, keys, "left_semi").dropDuplicates(keys), docs.columns)
