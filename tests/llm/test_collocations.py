"""Collocations: Misra-Gries guarantees, exact counts against a plain version, edge rows."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from martspark.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(docs, threshold=10, top=2000):
    """Counters in memory and exact integers."""
    words, counts = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in (1, 2, 3):
                counts.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    counts = {k: n for k, n in counts.items() if n >= threshold}
    rows = []
    for (lang, w), a in counts.items():
        if len(w) == 1:
            continue
        over = [n for (other, longer), n in counts.items()
                if other == lang and len(longer) == 3 and len(w) == 2 and w in (longer[:2], longer[1:])]
        if any(100 * n >= 50 * a for n in over):
            continue
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k,
                                     counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        rows.append((lang, " ".join(w), a, left, right, words[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for row in rows:
        at[row[0]] += 1
        if at[row[0]] <= top:
            ranked.append((row[0], at[row[0]], *row[1:]))
    return ranked


def mined(spark, docs, **options):
    rows = [(k, text, lang, "clash", 1) for k, (text, lang) in enumerate(docs)]
    found = C.collocations(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())


@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), max_size=40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_merged_summaries_keep_every_frequent_key(parts):
    """Whatever the order and number of merges, no key at the threshold is lost and bounds hold."""
    truth = Counter()
    for part in parts:
        for key, n in part:
            truth[key] += n
    mass, threshold = sum(truth.values()), 10
    summary = C.Summary(mass // threshold + 1)
    for part in parts:
        summary.merge(*C._summed(np.array([k for k, _ in part], np.uint64), np.array([n for _, n in part], np.int64)))
        summary.settle()
        assert len(summary.keys) <= summary.capacity
    assert summary.taken * (summary.capacity + 1) <= mass and summary.taken < threshold
    kept = set(summary.survivors(threshold).tolist())
    assert {k for k, n in truth.items() if n >= threshold} <= kept
    for key, n in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert n <= truth[key] <= n + summary.taken


def test_summary_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    counts = np.arange(len(keys), dtype=np.int64)
    found = C.unpacked_summary(**C.packed_summary(keys, counts))
    assert (found[0] == keys).all() and (found[1] == counts).all()


def random_docs(seed, n=120, vocabulary=9):
    rng = np.random.default_rng(seed)
    return [(" ".join(f"w{k}" + ("." if rng.random() < 0.1 else "") for k in rng.zipf(1.5, 60) % vocabulary),
             [None, "en", "de"][rng.integers(3)]) for _ in range(n)]


def test_against_plain_counting(spark):
    docs = random_docs(3)
    assert mined(spark, docs) == plain(docs)
    assert mined(spark, docs, top=5) == plain(docs, top=5)


def test_many_hash_partitions_and_key_ranges(spark, monkeypatch):
    """Small bounds force merges that take counters off and several ranges of the second pass."""
    monkeypatch.setattr(C, "COUNTERS", 256)
    monkeypatch.setattr(C, "BITMAP_KEYS", 40)
    monkeypatch.setattr(C, "BITMAP_BITS", 1 << 12)
    docs = random_docs(4) + [(" ".join(f"rare{k * 50 + j}" for j in range(50)), "en") for k in range(40)]
    assert mined(spark, docs) == plain(docs)


def test_edge_rows(spark):
    docs = [(None, "en"), ("", None), ("... \t ,;", "en"), ("A b", None), ("a\x0bb", "en")]
    docs += [("New York\tcity  new york", "en")] * 10 + [("Ä ö Ä ö!Ä ö", None)] * 6
    docs += [("x y " * 200_000, "long")]
    found = mined(spark, docs)
    assert found == plain(docs)
    assert ("en", 1) in {(r[0], r[1]) for r in found}


def test_ties_are_ordered_by_bytes(spark):
    docs = [(". ".join(f"{a} {b}" for a, b in (("é", "q"), ("z", "q2"), ("b", "c"), ("\U0001f600", "k"), ("￮", "k2"))), "x")] * 12
    found = mined(spark, docs)
    assert found == plain(docs)
    assert [r[2].encode() for r in found] == sorted(r[2].encode() for r in found)


def test_empty_table(spark):
    assert mined(spark, []) == []
