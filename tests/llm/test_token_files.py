"""Token files: encoder against the library, round trip, edge rows, sequences and masks."""

import random
import zlib

import numpy as np

from martspark.llm.bpe import Encoder, default_tokenizer, segments
from martspark.llm.token_files import ShardReader, read_token_digests, token_digests, write_token_files


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_segment_ids_equal_whole_text_ids():
    encoder = Encoder(default_tokenizer())
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", "日", "\xa0", "\x1c", ".", "!?", "'t", " '", "\r\n", "🙂",
             "<|endoftext|>", " the", " of"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 16)))
        assert "".join(segments(text)) == text
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library_ids(encoder.tokenizer, text), repr(text)


def expected(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in rows:
        ids = library_ids(tokenizer, text) + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digests(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=lambda r: r[1])


def test_digests_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    tokenizer = Encoder(default_tokenizer()).tokenizer
    assert digests(token_digests(docs, default_tokenizer())) == expected(rows, tokenizer)


def test_edge_rows_and_sequences(spark, tmp_path):
    long = "word and " * 30_000
    many = " x y z" * 9_000  # over one batch of rows
    rows = [(8, many), (5, "b c"), (3, None), (None, "no id"), (4, ""), (9, long), (5, "b c"), (7, "!!")]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, start string, shard int")
    path = str(tmp_path / "out")
    manifest = write_token_files(docs, path, default_tokenizer(), length=64, shards=3).collect()
    tokenizer = Encoder(default_tokenizer()).tokenizer
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert digests(read_token_digests(spark, path)) == expected(ordered, tokenizer)
    everything = []
    for row in sorted(manifest, key=lambda r: r.shard):
        reader = ShardReader(f"{path}/shards", row.file)
        n = -(-row.n_ids // 64)
        for k in range(n):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 64 and mask.sum() == min(64, row.n_ids - 64 * k)
            everything += ids[mask].tolist()
        assert not reader.batch(0)[0].flags.owndata  # a view of the mapped file
    assert everything == [i for _, text in ordered for i in library_ids(tokenizer, text) + [0]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_digests(docs, default_tokenizer()).count() == 0


def test_batches_give_the_library_s_ids(monkeypatch):
    """Odd white space, marks, long texts and a cache without room: ids as from the library, text by text."""
    import random

    import pyarrow as pa

    from martspark.llm import bpe

    rng = random.Random(1)
    texts = [None, "", " ", "  ", "a  b", " a", "a ", "x\n y", "x \n y", "a \x85b c", "a 　b", "don't. can't, won't! (a)", "b" * 100_000,
             "one two. " * 20_000]
    texts += ["".join(rng.choice(" \n\t\x0b\x85 　ab.,é'😀\x1d") for _ in range(40)) for _ in range(800)]
    for bound, size in ((1_500_000, 8 << 20), (3, 1 << 10)):
        monkeypatch.setattr(bpe, "KEPT_SEGMENTS", bound)
        monkeypatch.setattr(bpe, "SLICE_BYTES", size)
        encode = bpe.Encoder(bpe.default_tokenizer())
        expected = [e.ids for e in encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        got = [ids for flat, n in encode.batch(pa.array(texts)) for ids in np.split(flat, np.cumsum(n)[:-1])]
        assert [ids.tolist() for ids in got] == expected
        assert b"".join(encode.pieces(texts[-1])[1]) == np.array(expected[-1], "<u4").tobytes()
