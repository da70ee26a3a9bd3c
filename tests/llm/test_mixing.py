"""Raking against a plain loop, expected shares, decisions, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martspark.llm.mixing import MARGINS, fit_topics, mix, rake, sample_mixture, word_counts


def plain_raking(cells, targets, rounds=4000):
    weights = {key: float(tokens) for key, tokens in cells.items() if tokens}
    total = sum(weights.values())
    for _ in range(rounds):
        for place, margin in enumerate(MARGINS):
            now = {}
            for key, w in weights.items():
                now[key[place]] = now.get(key[place], 0) + w
            live = {v: s for v, s in targets[margin].items() if v in now}
            scale = total / sum(live.values())
            weights = {key: w * live.get(key[place], 0) * scale / now[key[place]] if now[key[place]] else 0
                       for key, w in weights.items()}
    return weights


def test_raking_meets_given_targets(spark):
    rng = np.random.default_rng(1)
    cells = {(s, lang, t): int(rng.integers(0, 1000)) for s in "abcd" for lang in ("en", "de", "") for t in range(3)}
    targets = {"source": {"a": 1, "b": 2, "c": 3, "d": 1, "unseen": 5}, "lang": {"en": 0.5, "de": 0.3, "": 0.2},
               "topic": {0: 1, 1: 1, 2: 2}}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic long, tokens long")
    tables = {m: spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()],
                                       f"{m} {'long' if m == 'topic' else 'string'}, share double") for m in MARGINS}
    got = {(r.source, r.lang, r.topic): r.weight for r in rake(df, tables).collect()}
    expected = plain_raking(cells, targets)
    assert got.keys() == expected.keys()
    for key, weight in expected.items():
        assert got[key] == pytest.approx(weight, rel=5e-3)


def test_sample_has_the_target_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs).collect()
    assert len(rows) == 1000 and {r.doc_id for r in rows} == set(range(1000))
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    assert all(r.n_tokens == words[r.doc_id] for r in rows)
    total = sum(words.values())
    for margin in MARGINS:
        plain, expected = {}, {}
        for r in rows:
            plain[getattr(r, margin)] = plain.get(getattr(r, margin), 0) + r.n_tokens
            expected[getattr(r, margin)] = expected.get(getattr(r, margin), 0) + r.n_tokens * r.factor
        whole = sum(n ** 0.9 for n in plain.values() if n)
        for value, n in plain.items():
            assert expected[value] == pytest.approx(n ** 0.9 / whole * total, rel=5e-3), (margin, value)
    assert max(r.probability for r in rows) == pytest.approx(1)
    kept = [r for r in rows if r.kept]
    assert len(kept) == pytest.approx(sum(r.probability for r in rows), rel=0.08)
    assert {r.doc_id for r in sample_mixture(docs).collect()} == {r.doc_id for r in kept}


def test_edge_rows(spark):
    rows = [(1, "a b c", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "x y", None, "s"), (4, "q " * 200_000, "de", "t"),
            (1, "a b c", "en", "s")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, factor double")
    got = mix(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 200_000)]
    assert all(0 < r.probability <= 1 for r in got)
    twins = [r for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]
    kept = sample_mixture(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert mix(docs.limit(0)).count() == 0 and sample_mixture(docs.limit(0)).count() == 0
    wordless = docs.filter(F.col("doc_id").isin(2, 3))
    assert [r.kept for r in mix(wordless).collect()] == [True, True]


def test_topics_come_from_all_documents(spark):
    """A text with thousands of copies and a rare language: all documents count in the means, and topics stay apart."""
    texts = spark.range(2000).select(F.concat(F.lit("hot text "), "id").alias("text"))
    hot = texts.orderBy(F.xxhash64("text", F.lit(7))).first().text  # its hash comes before those of the others
    rows = [(hot, "en")] * 6000 + [("", "en")] * 500
    subjects = ["tree leaf root bark", "ship sail mast deck", "bread flour yeast oven"]
    rare = [(f"{subjects[n % 3]} {subjects[n % 3]} n{n}", "xx") for n in range(30)]
    docs = spark.createDataFrame(rows + rare, "text string, lang string").repartition(4)
    topics = fit_topics(docs)
    vectors = {"en": [word_counts(hot)[1]], "xx": [word_counts(t)[1] for t, _ in rare]}
    offsets = {r.lang: r.offsets for r in topics.offsets.collect()}
    for lang, own in vectors.items():
        mean = np.mean([v / np.linalg.norm(v) for v in own], axis=0)
        assert offsets[lang] == pytest.approx(list(topics.centres @ mean + (topics.centres ** 2).sum(1) / 2))
    found = mix(docs.withColumns({"doc_id": F.monotonically_increasing_id(), "source": F.lit("s")})).filter("lang = 'xx'")
    assert found.select("topic").distinct().count() >= 3
