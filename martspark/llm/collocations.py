"""Phrase collocation mining: Misra-Gries summaries find every frequent n-gram, a second pass counts exactly.

**First pass.** A task reduces the n-grams of its texts to sorted 64-bit keys with counts and
sends one summary per hash partition. A hash partition merges the summaries of all tasks
into one Misra-Gries summary: counters are added, and when there are more than ``k`` of them
the (k+1)-th largest is taken off all. Its capacity ``k`` exceeds mass / threshold, where the
mass is the number of n-gram occurrences in that partition (the masses are sorted before
the summaries, so ``k`` is known when the first of them comes). What is taken off a counter in all is
therefore less than the threshold, so every n-gram that occurs often enough survives;
``counter + taken off`` bounds its count from above and drops most others. There are as many
hash partitions as keep ``k`` near ``COUNTERS``, so memory does not depend on the corpus.

**Second pass.** The texts are read again; n-grams whose key survived are counted exactly, by
their words, not by their keys. Survivors reach the tasks as a bitmap of fixed size
(``BITMAP_BITS``), of which each hash partition owns a slice. When there are more than
``BITMAP_KEYS`` survivors, the key space is cut into ranges and the pass runs once per range,
each with a bitmap of its own; so what is sent does not grow. A key that shares a bit with
a survivor costs a count that is dropped afterwards and changes nothing.

Scores, cuts and the drop rule are joins over the exact counts. Products use decimals of
38 digits. The first ``TOP`` phrases of a language come from per-salt tops, so no task sorts all
its candidates.

Defined results: a missing text is empty; a missing language is ``und``; documents count
one by one, also repeated ones, whatever their id; other columns are not read, whatever their
names; a text is cut into bounded slices of pieces, so its length does not matter. An empty table
gives no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martspark.session import shared_folder, written

THRESHOLD = 10
LONGEST = 3
TOP = 2000
DROP_PERCENT = 50
UNKNOWN_LANG = "und"

COUNTERS = 1 << 19  # wanted capacity of a hash partition's summary
BITMAP_BITS = 1 << 27  # 16 MiB, whatever the corpus
BITMAP_KEYS = 1 << 23  # survivors per bitmap: at most one bit in sixteen is set
SLICE_BYTES = 4 << 20  # text that is looked at together
TASK_KEYS = 2 << 20  # keys a task holds before it sends them
SALTS = 64

PIECE_END = r"[.,;:!?\x0A-\x0D]"
GAP = r"[\x20\x09]+"

_U = np.uint64
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _hashes(strings: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings), _U, len(strings))


class Slice:
    """Words of some pieces: word ids into ``words``, the language of each place, and keys of its n-grams."""

    def __init__(self, pieces: pa.Array, langs: np.ndarray, names: list[str], name_hashes: np.ndarray):
        split = pc.split_pattern_regex(pieces, pattern=GAP)
        coded = split.flatten().dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy()
        piece = np.repeat(np.arange(len(pieces)), np.diff(split.offsets.to_numpy()))
        is_word = np.asarray(pc.not_equal(self.words, ""))
        real = is_word[ids]
        self.ids, piece = ids[real], piece[real]
        self.langs, self.names = langs[piece], names
        self.hashes = _hashes(self.words.to_pylist())[self.ids]
        self.lang_hashes = name_hashes[self.langs]
        self.joined = piece[1:] == piece[:-1]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length the places where an n-gram begins and their keys."""
        goes_on = np.append(self.joined, False)  # the next word lies in the same piece
        places, keys = np.arange(len(self.ids)), _mixed(self.hashes ^ self.lang_hashes)
        yield 1, places, keys
        for n in range(2, LONGEST + 1):
            longer = goes_on[places + (n - 2)]
            places, keys = places[longer], keys[longer]
            keys = _mixed(keys * _U(3) + self.hashes[places + (n - 1)])
            yield n, places, keys

    def counted(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One place and the count of each distinct n-gram of a language; equal word ids are equal words."""
        code, most = self.langs[places].astype(np.int64), len(self.names)
        for k in range(n):
            if most * len(self.words) >= 1 << 62:  # number the codes anew before they overflow
                distinct, code = np.unique(code, return_inverse=True)
                most = len(distinct)
            code = code * len(self.words) + self.ids[places + k]
            most *= len(self.words)
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return places[first], counts

    def phrases(self, places: np.ndarray, n: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.ids[places + k])) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def slices(frames: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Bounded slices of the pieces of ``lang, text`` batches."""
    for frame in frames:
        lang, text = frame.column(0).dictionary_encode(), frame.column(1)
        names = lang.dictionary.to_pylist()
        name_hashes, lang_ids = _hashes(names), lang.indices.to_numpy()
        sizes = np.cumsum(pc.binary_length(text).to_numpy())
        at = 0
        while at < len(text):
            # Rows of a group hold about so many bytes together, one row at least.
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            cut = pc.split_pattern_regex(pc.ascii_lower(text.slice(at, end - at)), pattern=PIECE_END)
            pieces = cut.flatten()
            langs = np.repeat(lang_ids[at:end], np.diff(cut.offsets.to_numpy()))
            ends = np.cumsum(pc.binary_length(pieces).to_numpy())
            low = 0
            while low < len(pieces):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
                found = Slice(pieces.slice(low, high - low), langs[low:high], names, name_hashes)
                if len(found.ids):
                    yield found
                low = high
            at = end


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of the same weight side by side, which compress well."""
    planes = values.astype("<u8").view(np.uint8).reshape(len(values), 8).T
    return _ZSTD.compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZSTD.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, len(planes) // 8).T).view("<u8").ravel()


def packed_summary(keys: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """Sorted keys as differences; the small counts beside them."""
    return {"keys": _packed(np.diff(keys, prepend=_U(0))), "counts": _packed(counts)}


def unpacked_summary(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(keys), dtype=_U), _unpacked(counts).astype(np.int64)


class Summary:
    """A mergeable Misra-Gries summary of at most ``capacity`` counters.

    ``taken`` is what was taken off every counter in all: less than mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, _U), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, COUNTERS):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        self.keys, self.counts = _summed(np.concatenate([self.keys, *(k for k, _ in self.waiting)]),
                                         np.concatenate([self.counts, *(c for _, c in self.waiting)]))
        self.waiting, self.n_waiting = [], 0
        if len(self.keys) > self.capacity:
            place = len(self.keys) - self.capacity - 1
            off = int(np.partition(self.counts, place)[place])
            left = self.counts > off
            self.keys, self.counts, self.taken = self.keys[left], self.counts[left] - off, self.taken + off

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have reached the threshold; every one that did is among them."""
        self.settle()
        return self.keys[self.counts + self.taken >= threshold]


def task_summaries(frames: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, mass, keys, counts``: the masses apart from the summaries they belong to."""
    held_keys, held_counts, held = [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(np.concatenate(held_keys), np.concatenate(held_counts))
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.zeros(1, int)
        edges = np.append(edges, len(keys))
        for bucket in range(1 << bits):
            low, high = edges[bucket], edges[bucket + 1]
            if low == high:
                continue
            packed = packed_summary(keys[low:high], counts[low:high])
            yield pa.RecordBatch.from_pylist(
                [{"bucket": bucket, "mass": int(counts[low:high].sum()), "keys": None, "counts": None},
                 {"bucket": bucket, "mass": None, **packed}], schema=SUMMARY_ARROW)

    for piece in slices(frames):
        for _, _, keys in piece.grams():
            distinct, counts = np.unique(keys, return_counts=True)
            held_keys.append(distinct)
            held_counts.append(counts)
            held += len(distinct)
        if held > 2 * TASK_KEYS:
            keys, counts = _summed(np.concatenate(held_keys), np.concatenate(held_counts))
            held_keys, held_counts, held = [keys], [counts], len(keys)
            if held > TASK_KEYS:
                yield from rows()
                held_keys, held_counts, held = [], [], 0
    if held_keys:
        yield from rows()


SUMMARY = "bucket long, mass long, keys binary, counts binary"
SUMMARY_ARROW = pa.schema([("bucket", pa.int64()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
SURVIVORS = "bucket long, n long, taken long, capacity long, keys binary"
SURVIVORS_ARROW = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("taken", pa.int64()), ("capacity", pa.int64()),
                             ("keys", pa.binary())])


def merged_summaries(frames: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """One row of survivors per hash partition; rows come by partition, its masses first."""
    current, mass, summary = None, 0, None

    def finished() -> pa.RecordBatch:
        keys = summary.survivors(threshold)
        return pa.RecordBatch.from_pylist(
            [{"bucket": current, "n": len(keys), "taken": summary.taken, "capacity": summary.capacity,
              "keys": _packed(np.diff(keys, prepend=_U(0)))}], schema=SURVIVORS_ARROW)

    for frame in frames:
        for bucket, part, keys, counts in zip(*frame.columns):
            if bucket.as_py() != current:
                if summary is not None:
                    yield finished()
                current, mass, summary = bucket.as_py(), 0, None
            if part.is_valid:
                mass += part.as_py()
                continue
            summary = summary or Summary(mass // threshold + 1)
            summary.merge(*unpacked_summary(keys.as_py(), counts.as_py()))
    if summary is not None:
        yield finished()


def _with_small_batches(df: DataFrame, label: str) -> DataFrame:
    """Write a frame whose rows are large to the shared folder, few of them to an Arrow batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "64")
    try:
        return written(df, label)
    finally:
        conf.set(key, before)


def surviving_keys(texts: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, int]:
    """First pass over ``texts(lang, text)``: survivors per hash partition, and the partitions' number as a power of two."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and the separator behind it take two bytes at least; each word begins one n-gram per length at most.
    mass = LONGEST * (size + 1) // 2
    bits = max(0, (mass // threshold // COUNTERS).bit_length())
    summaries = texts.mapInArrow(lambda frames: task_summaries(frames, bits), SUMMARY)
    tasks = max(1, min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = summaries.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("mass").isNull())
    merged = dealt.mapInArrow(lambda frames: merged_summaries(frames, threshold), SURVIVORS)
    return _with_small_batches(merged, "survivors"), bits


def bitmap_slices(frames: Iterator[pa.RecordBatch], cut: int, bits: int, all_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``place, bits`` of one range's bitmap; a hash partition fills a run of bits of its own."""
    width = all_bits.bit_length() - 1
    size = all_bits >> (bits - cut)  # bits per hash partition
    for frame in frames:
        for bucket, packed in zip(frame.column(0).to_pylist(), frame.column(1)):
            keys = np.cumsum(_unpacked(packed.as_py()), dtype=_U)
            places = ((keys << _U(cut)) >> _U(64 - width)).astype(np.int64)
            first = (bucket & ((1 << (bits - cut)) - 1)) * size
            flags = np.zeros(size, np.uint8)
            flags[places - first] = 1
            yield pa.record_batch([pa.array([first // 8]), pa.array([np.packbits(flags, bitorder="little").tobytes()])],
                                  names=["place", "bits"])


def counted_phrases(frames: Iterator[pa.RecordBatch], bitmap, cut: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, phrase, n_words, n`` of one key range; ``phrase`` is null in the rows that count all words."""
    bitmap = np.frombuffer(bitmap.value, np.uint8)
    width = (8 * len(bitmap)).bit_length() - 1
    for piece in slices(frames):
        if part == 0:
            found, n = np.unique(piece.langs, return_counts=True)
            yield _phrase_rows(piece, found, pa.nulls(len(found), pa.string()), 0, n)
        for n_words, places, keys in piece.grams():
            if cut:
                inside = keys >> _U(64 - cut) == _U(part)
                places, keys = places[inside], keys[inside]
            spots = (keys << _U(cut)) >> _U(64 - width)
            kept = (bitmap[(spots >> _U(3)).astype(np.int64)] >> (spots & _U(7)).astype(np.uint8)) & 1 > 0
            places = places[kept]
            if not len(places):
                continue
            first, n = piece.counted(places, n_words)
            yield _phrase_rows(piece, piece.langs[first], piece.phrases(first, n_words), n_words, n)


def _phrase_rows(piece: Slice, langs: np.ndarray, phrases: pa.Array, n_words: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(piece.names, pa.string()).take(pa.array(langs)), phrases.cast(pa.string()),
                            pa.array(np.full(len(n), n_words, np.int32)), pa.array(n.astype(np.int64))],
                           names=["lang", "phrase", "n_words", "n"])


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``lang, phrase, n_words, n``: all phrases of up to three words that occur often enough, with exact counts.

    A row with a null phrase holds the number of all words of its language.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                        F.col("text").cast("string").alias("text")).filter("text is not null")
    survivors, bits = surviving_keys(texts, threshold)
    n_survivors = survivors.agg(F.sum("n")).first()[0] or 0
    cut = min(bits, (max(n_survivors - 1, 0) // BITMAP_KEYS).bit_length())
    cut = max(cut, bits - BITMAP_BITS.bit_length() + 4)  # a hash partition has whole bytes of the bitmap
    parts = []
    for part in range(1 << cut):
        own = survivors.filter(F.shiftright("bucket", bits - cut) == part).select("bucket", "keys")
        bitmap, all_bits = bytearray(BITMAP_BITS // 8), BITMAP_BITS
        parts_of_it = own.mapInArrow(lambda frames: bitmap_slices(frames, cut, bits, all_bits), "place long, bits binary")
        for place, flags in parts_of_it.collect():
            bitmap[place:place + len(flags)] = flags
        sent = spark.sparkContext.broadcast(bytes(bitmap))
        counts = texts.mapInArrow(lambda frames, p=part, b=sent: counted_phrases(frames, b, cut, p),
                                  "lang string, phrase string, n_words int, n long")
        summed = counts.groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n"))
        parts.append(written(summed.filter(F.col("phrase").isNull() | (F.col("n") >= threshold)), "phrases"))
        sent.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every candidate that no longer candidate makes redundant."""
    phrases = counts.filter("phrase is not null").select("lang", "phrase", "n_words", "n")
    candidates = phrases.filter("n_words > 1").withColumn("w", F.split("phrase", " "))

    def joined(first, last):
        return F.array_join(F.slice("w", first, last), " ")

    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(1), F.col("n_words") - 1),
        lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"),
                           joined(k + 1, F.col("n_words") - k).alias("right")))).alias("c"))
    ends = cuts.select("lang", "phrase", "a", F.col("c.k").alias("k"), F.explode(F.array(
        F.struct(F.lit(True).alias("is_left"), F.col("c.left").alias("part")),
        F.struct(F.lit(False).alias("is_left"), F.col("c.right").alias("part")))).alias("e"))
    part_counts = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    found = ends.join(part_counts, (F.col("lang") == F.col("_lang")) & (F.col("e.part") == F.col("_part")))
    sides = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("e.is_left"), F.col("_n"))).alias("l"),
                                                         F.max(F.when(~F.col("e.is_left"), F.col("_n"))).alias("r"))
    score = F.expr("(cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) * cast(1000000 as decimal(7, 0)))"
                   " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.filter(F.col("n_words") == LONGEST).select("lang", "n", F.explode(F.array_distinct(F.array(
        *(joined(F.lit(k), F.lit(LONGEST - 1)) for k in (1, 2))))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    return best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < DROP_PERCENT * F.col("a"))).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs(text, lang)`` by score."""
    shared_folder(docs.sparkSession)
    counts = frequent_phrases(docs, threshold)
    rows = scored(counts)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    firsts = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    words = counts.filter("phrase is null").select("lang", F.col("n").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
