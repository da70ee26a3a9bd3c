"""SimHash groups against brute force; edge rows; components against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from martspark.llm.components import components
from martspark.llm.simhash import (
    _manhattan,
    drop_near_duplicates,
    fingerprint,
    fingerprint_links,
    near_duplicates,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_majority_of_the_hashes():
    import xxhash

    text = "Aa bb\tcc\x0bdd aa BB cc dd\x85x é"
    words = ["aa", "bb", "cc", "dd", "aa", "bb", "cc", "dd\x85x", "é"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) & (1 << 64) - 1 == expected
    assert fingerprint("") == fingerprint(None) == fingerprint(" \n ") == 0
    assert fingerprint("One two") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("max_bits", [0, 2, 3, 5])
def test_links_are_all_pairs_within_the_radius(spark, max_bits):
    rng = random.Random(max_bits)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:  # groups around a few of them, one and several flips away
        for _ in range(6):
            near = v
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << bit
            values.append(near)
    values += [0, 1, (1 << 64) - 1, 7, 1 << 63]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.a, r.b) for r in fingerprint_links(df, max_bits).collect()}
    mask = (1 << 64) - 1
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= max_bits}
    assert got == expected
    pairs = df.crossJoin(df.withColumnRenamed("fp", "o")).withColumn("d", _manhattan(F.col("fp"), F.col("o")))
    for r in pairs.sample(0.02, 1).collect():
        count = lambda v: [((v & mask) >> 2 * k & 3).bit_count() for k in range(32)]
        assert r.d == sum(abs(x - y) for x, y in zip(count(r.fp), count(r.o)))


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    links += [(5, 5), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for link in real for n in link}, real)


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, fingerprint(r.text) & (1 << 64) - 1) for r in docs.select("doc_id", "text").collect()]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3]
    expected = roots([a for a, _ in rows], links)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {a: (f"{x:016x}", expected[a]) for a, x in rows}
    assert {r.doc_id for r in got if r.is_kept} == {a for a, root in expected.items() if a == root}
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == set(expected.values())


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(4, None, 1), (2, "", 2), (3, " \n", 3), (None, "a b c d", 4), (None, "A B C D", 5), (9, "a b c d", 6),
            (9, "a b c d", 7), (11, long, 8), (12, long + " w", 9), (None, "only here", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x"))
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {k: by_id[k].component_id for k in (2, 3, 4, 9, 11, 12)} == {2: 2, 3: 2, 4: 2, 9: 9, 11: 11, 12: 11}
    assert by_id[4].fingerprint == "0" * 16
    assert sorted((r.component_id or -1) for r in got if r.doc_id is None) == [-1, 9, 9]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "only here"), (2, ""), (9, "a b c d"), (11, long)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0
