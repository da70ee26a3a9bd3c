"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For every benchmark item, windows of the item's number of words slide over each
whole document. Windows and items have a 64-bit SimHash of their five-word
shingles. Items are indexed by ``max_bits + 1`` blocks of their fingerprint; two
fingerprints within ``max_bits`` agree in one block at least, so the index gives
all items within that radius. Those candidates are then compared exactly: the
weighted Jaccard similarity of the shingle multisets must reach ``min_similarity``.

A window is fingerprinted only where that can matter. The similarity of a window
cannot exceed the share of its shingles that occur in the benchmark at all, so
windows below ``min_similarity`` of such shingles are passed over; this loses
nothing, and leaves most of a clean document with one table lookup per word.

Words are runs of letters, digits and ``_`` in lower case, so punctuation and
layout do not matter. The benchmark is split into blocks of ``ITEMS_PER_BLOCK``
items, each sent to the tasks once; its size in memory is bounded whatever the
benchmark's size.

Defined results: a missing or wordless text or item matches nothing; an item or
document shorter than a shingle is one shingle of all its words; equal item texts
count once, under the smallest id; a document without id is reported with null;
repeated rows are reported each; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import batches

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
MAX_BITS = 19
ITEMS_PER_BLOCK = 20_000
MAX_ITEM_CHARS_PER_BLOCK = 16 << 20
REGION = 8192
FILTER_BITS = 22

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], size: int = SHINGLE_WORDS) -> list[str]:
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return [" ".join(group) for group in zip(*(words[k:] for k in range(size)))]


def shingle_bits(items: list[str]) -> np.ndarray:
    """One row of 64 zeros and ones per shingle."""
    import xxhash

    hashes = np.fromiter((xxhash.xxh64_intdigest(item) for item in items), np.uint64, len(items))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack_bits(counts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from the bit counts of windows with ``n`` shingles."""
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[key]) for key, n in a.items() if key in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class BlockIndex:
    """Items of one window size, found by any equal block of their fingerprints."""

    def __init__(self, fingerprints: np.ndarray, max_bits: int):
        self.fingerprints, self.max_bits = fingerprints, max_bits
        edges = np.linspace(0, 64, max_bits + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            keys = (fingerprints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
            places = defaultdict(list)
            for at, key in enumerate(keys.tolist()):
                places[key].append(at)
            self.blocks.append((np.uint64(low), np.uint64((1 << int(high - low)) - 1),
                                {key: np.array(found) for key, found in places.items()}))

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """Places of all items at ``max_bits`` differing bits or fewer."""
        found = [places.get(int((fingerprint >> low) & mask)) for low, mask, places in self.blocks]
        found = [f for f in found if f is not None]
        if not found:
            return np.zeros(0, int)
        at = np.unique(np.concatenate(found))
        return at[np.bitwise_count(self.fingerprints[at] ^ fingerprint) <= self.max_bits]


class Benchmark:
    """A block of items, ready for scanning documents; built once per worker process."""

    def __init__(self, items: list[tuple[int, str]], max_bits: int, min_similarity: float):
        self.min_similarity = min_similarity
        self.sizes: dict[int, dict] = {}
        by_size: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_size[len(words)].append((item_id, shingles(words)))
        known: dict[int, set] = defaultdict(set)
        for size, members in by_size.items():
            prints = np.concatenate([pack_bits(shingle_bits(s).sum(0, dtype=np.int64)[None], len(s)) for _, s in members])
            self.sizes[size] = {"ids": [i for i, _ in members], "counts": [Counter(s) for _, s in members],
                                "index": BlockIndex(prints, max_bits)}
            known[min(size, SHINGLE_WORDS)].update(x for _, s in members for x in s)
        # Shingle length -> a table of hashed shingles for a first look, and the shingles themselves.
        self.known = {}
        for length, texts in known.items():
            table = np.zeros(1 << FILTER_BITS, bool)
            for text in texts:
                table[self._slots(self._hashes(text.split(" ")), length)] = True
            self.known[length] = (table, texts)

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def _slots(hashes: np.ndarray, length: int) -> np.ndarray:
        mixed = np.zeros(len(hashes) - length + 1, np.uint64)
        for k in range(length):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - length + 1 + k]
        return mixed >> np.uint64(64 - FILTER_BITS)

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """``item_id, start word, words, bits, similarity`` of each matching item's best window."""
        words = words_of(text)
        best: dict[int, tuple] = {}
        if not words:
            return []
        hashes = self._hashes(words)
        for length, (table, texts) in self.known.items():
            if len(words) < length:
                continue
            marked = np.flatnonzero(table[self._slots(hashes, length)])
            marked = np.array([at for at in marked if " ".join(words[at:at + length]) in texts], dtype=int)
            if not len(marked):
                continue
            total = np.zeros(len(words) - length + 2, np.int64)
            np.add.at(total, marked + 1, 1)
            total = np.cumsum(total)
            for size, group in self.sizes.items():
                if min(size, SHINGLE_WORDS) == length:
                    self._scan(words, total, length, size, group, best)
        return sorted((item, *found[1:]) for item, found in best.items())

    def _scan(self, words, total, length, size, group, best) -> None:
        """Look at the windows of one size where enough shingles are known."""
        width = min(size, len(words))
        n = width - length + 1
        known = total[n:] - total[:-n]
        starts = np.flatnonzero(known >= self.min_similarity * n - 1e-9)
        for low in range(0, len(starts), REGION):
            chosen = starts[low:low + REGION]
            for region in np.split(chosen, np.flatnonzero(np.diff(chosen) > n) + 1):
                first, last = int(region[0]), int(region[-1]) + n
                texts = [" ".join(words[at:at + length]) for at in range(first, last)]
                sums = np.zeros((len(texts) + 1, 64), np.int32)
                np.cumsum(shingle_bits(texts), axis=0, out=sums[1:])
                at = region - first
                for start, print_ in zip(region.tolist(), pack_bits(sums[at + n] - sums[at], n)):
                    places = group["index"].near(print_)
                    if not len(places):
                        continue
                    window = Counter(texts[start - first:start - first + n])
                    for place in places.tolist():
                        similarity = weighted_jaccard(window, group["counts"][place])
                        if similarity >= self.min_similarity:
                            bits = int(np.bitwise_count(group["index"].fingerprints[place] ^ print_))
                            item = group["ids"][place]
                            found = (similarity, start, width, bits, similarity)
                            if item not in best or (-similarity, start) < (-best[item][0], best[item][1]):
                                best[item] = found


def benchmark_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct texts in blocks of bounded size, each with its smallest id."""
    rows = items.filter("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(
        F.min(F.col("item_id").cast("long")).alias("item_id")).filter("item_id is not null").select("item_id", "text")
    block, chars = [], 0
    for row in rows.toLocalIterator():
        if block and (len(block) >= ITEMS_PER_BLOCK or chars + len(row.text) > MAX_ITEM_CHARS_PER_BLOCK):
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield block


def _benchmark(sent, max_bits: int, min_similarity: float) -> Benchmark:
    """This worker's scanner for a sent block of items, kept with the block itself."""
    if not hasattr(sent, "scanner"):
        sent.scanner = Benchmark(sent.value, max_bits, min_similarity)
    return sent.scanner


def contaminated(docs: DataFrame, items: DataFrame, max_bits: int = MAX_BITS,
                 min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, bits, similarity``: the best window per document and item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start_word long, n_words long, bits long, similarity double"
    names = [part.split()[0] for part in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for block in benchmark_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def scan(frames, sent=sent):
            benchmark = _benchmark(sent, max_bits, min_similarity)
            for frame in batches(frames):
                rows = [(doc_id, *hit) for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1))
                        for hit in benchmark.hits(text.as_py())]
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        found = texts.mapInArrow(scan, schema)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result


def drop_contaminated(docs: DataFrame, items: DataFrame, max_bits: int = MAX_BITS,
                      min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The rows without any match, with their own columns; one pass per block of items, without a shuffle."""
    place = docs.columns.index("text")
    for block in benchmark_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(frames, sent=sent):
            benchmark = _benchmark(sent, max_bits, min_similarity)
            for frame in batches(frames):
                yield frame.filter(pa.array([not benchmark.hits(text.as_py()) for text in frame.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
