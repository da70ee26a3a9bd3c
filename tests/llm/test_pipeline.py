"""The pipeline: each stage against brute force on its own input, the whole run, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martspark.llm.bpe import default_tokenizer, encoder
from martspark.llm.decontaminate import contaminated
from martspark.llm.mixing import mix
from martspark.llm.quality_rules import quality_verdicts
from martspark.llm.simhash import fingerprint
from martspark.session import written

FOLDER = "/root/testdata/sf0.001"


def smallest_of_groups(rows):
    """Ids that stay when one document of each group of linked fingerprints does."""
    mask = (1 << 64) - 1
    prints = [(k, fingerprint(text) & mask) for k, text in rows]
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k for k in root if find(k) == k}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "mixing_weights", "token_files"]

    good = written(stages["quality_rules"](spark, docs, FOLDER), "t")
    assert ids(good) == ids(quality_verdicts(docs).filter("kept")) and 0 < good.count() < docs.count()
    single = written(stages["near_duplicates"](spark, good, FOLDER), "t")
    assert ids(single) == smallest_of_groups([(r.doc_id, r.text) for r in good.collect()])
    clean = written(stages["benchmark_decontamination"](spark, single, FOLDER), "t")
    found = ids(contaminated(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")))
    assert ids(clean) == ids(single) - found and found
    mixed = written(stages["mixing_weights"](spark, clean, FOLDER), "t")
    assert ids(mixed) == ids(mix(clean).filter("kept"))
    for df in (good, single, clean, mixed):
        assert df.columns == columns
        assert df.join(docs, columns, "left_anti").count() == 0  # rows are handed on unchanged

    encode, start, expected = encoder(default_tokenizer()).tokenizer, 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        tokens = encode.encode(r.text, add_special_tokens=False).ids + [0]
        expected.append((r.doc_id, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == expected


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, name):
    text = " ".join(f"word{k} of the text" for k in range(80))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text + " x", None, None, None), (2, None, "en", "s", 0),
            (3, "", None, "s", 0), (4, text * 300, "de", None, 9), (5, "short", "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"words": F.lit("clash"), "fp": F.lit(1), "kept": F.lit(False), "topic": F.lit("x"), "_row": F.lit(2)})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, FOLDER)
    n = out.count()
    if name == "token_files":
        assert n == len(rows)
    else:
        assert out.columns == docs.columns and n <= len(rows)
    if name == "near_duplicates":
        assert n == len(smallest_of_groups(list(enumerate(r[1] for r in rows))))
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
