"""Quality rules: base counts against brute force, edge rows, clashing columns."""

import re
from collections import Counter

from martspark.llm.quality_rules import keep_good, quality_verdicts


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


EDGE = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c a b c", "a a a a a", "x y z\x85w", "l1 a\nl1 a\n\n \nl1 a", "🙂 #$ é\n",
        "a b c d a b c x a b c", "w " * 60_000]


def test_base_counts_and_edge_rows(spark):
    rows = [(k if k % 3 else None, t, None if k % 2 else "xx", "s") for k, t in enumerate(EDGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    got = quality_verdicts(docs).collect()
    assert Counter(map(counts, got)) == Counter(base_counts(t) for t in EDGE)
    assert all(r.base_failed and not r.kept for r in got)  # all short or repetitive
    assert keep_good(docs).columns == docs.columns


def test_documents_and_rejections(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert {k: counts(r) for k, r in got.items()} == {k: base_counts(t) for k, t in texts.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1 and not got[k].base_failed]
    bad = [k for k, q in labels.items() if q == 0]
    assert all(got[k].kept for k in good)
    assert sum(not got[k].kept for k in bad) >= 0.8 * len(bad)
    assert {r.doc_id for r in keep_good(docs).collect()} == {k for k, r in got.items() if r.kept}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_verdicts(docs).count() == 0 and keep_good(docs).count() == 0


def test_verdicts_can_be_filtered(spark):
    """A filter over the verdict is as quick as the verdict: it is not unfolded through the counts below it."""
    import time

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start = time.time()
    kept = {r.doc_id for r in quality_verdicts(docs).filter("kept and word_distance < 0.5 and n_symbols >= 0").select("doc_id").collect()}
    assert time.time() - start < 60
    assert kept == {r.doc_id for r in quality_verdicts(docs).collect() if r.kept and r.word_distance < 0.5}


def test_long_common_words_and_languages_without_any(spark):
    """Words of any length are references; a language without a common word is still judged by its characters."""
    common = "constantinople otherwise# "
    rows = [(k, common * 10 + " ".join(f"w{k}x{j}" for j in range(100)), "aa", "s") for k in range(20)]
    rows += [(100 + k, " ".join(f"q{chr(97 + j % 26)}{chr(97 + k)}{chr(97 + j // 26)}" for j in range(200)), "bb", "s") for k in range(20)]
    rows += [(200, " ".join(f"{j}9481{j}" for j in range(200)), "bb", "s"), (201, " ".join(f"z{j}y" for j in range(200)), "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert got[200].char_distance > 0.3 and not got[200].kept and got[200].word_distance == 0.0
    assert got[100].kept and got[0].kept
    assert got[201].word_distance > 0.2 > got[0].word_distance
