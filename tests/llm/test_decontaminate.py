"""Decontamination against a scan of all windows; planted passages; edge rows."""

import random
from collections import Counter

import pytest
import xxhash

from martspark.llm.decontaminate import (
    MAX_BITS,
    BlockIndex,
    contaminated,
    drop_contaminated,
    pack_bits,
    shingle_bits,
    shingles,
    weighted_jaccard,
    words_of,
)

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(items):
    hashes = [xxhash.xxh64_intdigest(x) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_windows(text, items):
    """Best window per item, over every window of every item's size."""
    words, out = words_of(text), {}
    for item_id, item in items:
        target = words_of(item)
        if not target or not words:
            continue
        width = min(len(target), len(words))
        mine = shingles(target)
        for start in range(len(words) - width + 1):
            window = shingles(words[start:start + width])
            similarity = weighted_jaccard(Counter(window), Counter(mine))
            bits = (plain_fingerprint(window) ^ plain_fingerprint(mine)).bit_count() if similarity >= 0.8 else 99
            if similarity >= 0.8 and bits <= MAX_BITS and similarity > out.get(item_id, (0,))[0]:
                out[item_id] = (similarity, start, width)
    return {k: v[1:] for k, v in out.items()}


@pytest.fixture(scope="module")
def fixture(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    clean = sorted((r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(r.text) > 200), key=len)[:12]
    rng = random.Random(1)
    docs = [(k, text) for k, text in enumerate(clean)]
    for n, (_, item) in enumerate(items):
        words, host = item.split(), clean[n % len(clean)]
        half = len(host) // 2
        changed = words.copy()
        changed[len(words) // 2] = "changed"
        docs += [(100 + n, host[:half] + " " + item + " " + host[half:]), (200 + n, item.upper().replace(" ", "  ")),
                 (300 + n, host + " " + " ".join(changed) + " end"), (400 + n, " ".join(words[:-1])),
                 (500 + n, item + "\n" + host + "\n" + item), (600 + n, " ".join(rng.sample(words, len(words))))]
    return items, docs


def test_equals_all_windows(spark, fixture):
    items, docs = fixture
    expected = {k: found for k, text in docs if (found := all_windows(text, items))}
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got: dict = {}
    for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = (r.start_word, r.n_words)
    assert got == expected
    assert all(k in got for n in range(len(items)) for k in (100 + n, 200 + n, 500 + n))  # whole passages, in any layout
    assert not any(k in got for k in range(12))
    kept = drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - set(expected)


def test_index_finds_everything_within_the_radius():
    rng = random.Random(2)
    texts = [[f"w{rng.randint(0, 60)}" for _ in range(30)] for _ in range(200)]
    prints = [pack_bits(shingle_bits(shingles(t)).sum(0)[None].astype(int), 26)[0] for t in texts]
    import numpy as np

    for bits in (0, 3, 19):
        index = BlockIndex(np.array(prints, dtype=np.uint64), bits)
        for probe in prints[:20]:
            near = [k for k, p in enumerate(prints) if (int(p) ^ int(probe)).bit_count() <= bits]
            assert index.near(probe).tolist() == near


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    long = "filler " * 100_000 + item + " end " * 10
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, long), (5, "..."), (6, "tiny item"), (7, "a tiny item here")]
    items = [(9, item), (8, item), (1, None), (2, ""), (3, "tiny item"), (None, "no id at all in this one")]
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, similarity string")
    b = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.start_word) for r in contaminated(d, b).collect())
    assert got == [(0, 8, 0), (3, 8, 0), (3, 8, 0), (4, 8, 100_000), (6, 3, 0), (7, 3, 1)]
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [1, 2, 5]
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == len(docs)
