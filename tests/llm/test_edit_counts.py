"""Edit-aware counts against encoding the edited text anew."""

import random
import time

from martspark.llm.bpe import default_tokenizer, encoder
from martspark.llm.edit_counts import REDACTED, KeptTree, TokenTree, edited_counts, edited_trees, redactions, token_trees

PARTS = ["a", "the", " ", " ", " of", "  ", "\n", "\t", "'s", "12", "é", "日", "\xa0", ".", "!?", " '", "\r\n", "🙂", " word"]


def full(encode, text):
    return len(encode.tokenizer.encode(text, add_special_tokens=False).ids)


def random_edits(rng, n):
    cuts = sorted(rng.randint(0, n) for _ in range(2 * rng.randint(0, 4)))
    return [(a, b, "".join(rng.choices(PARTS, k=rng.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2])]


def test_random_edits_equal_full_counts(monkeypatch):
    encode = encoder(default_tokenizer())
    rng = random.Random(4)
    for size in (1, 2, 32):
        monkeypatch.setattr("martspark.llm.edit_counts.LEAF_SEGMENTS", size)
        for _ in range(1200):
            text = "".join(rng.choices(PARTS, k=rng.randint(0, 60)))
            tree = TokenTree.build(text, encode)
            assert tree.total == full(encode, text)
            new = tree.apply(random_edits(rng, len(text)), encode)
            assert tree.total == full(encode, new), (text, new)
            for k in range(1, len(tree.sums) // 2):
                assert tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1]


def test_only_touched_regions_are_encoded():
    encode = encoder(default_tokenizer())
    text = "some words here " * 20_000
    tree = TokenTree.build(text, encode)
    new = tree.apply([(160_000, 160_004, "other")], encode)
    assert tree.total == full(encode, new) and tree.n_reencoded < 1000


def test_documents_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encode = encoder(default_tokenizer())
    got = {r.doc_id: r for r in edited_counts(token_trees(docs, default_tokenizer()), default_tokenizer(), rule=redactions).collect()}
    for r in docs.collect():
        edits, new, at = redactions(r.text), [], 0
        for start, end, tag in edits:
            new += [r.text[at:start], tag]
            at = end
        after = "".join(new) + r.text[at:]
        row = got[r.doc_id]
        assert (row.n_tokens, row.n_tokens_after, row.n_edits) == (full(encode, r.text), full(encode, after), len(edits))
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "x y z")]
    edge = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, starts int, sums string")
    edits = spark.createDataFrame([(1, 0, 0, "new text"), (3, 2, 3, None), (3, 0, 1, "q"), (3, 2, 5, "over"), (3, 9, 9, "out"),
                                   (8, 0, 0, "no document"), (None, 0, 0, "no id")],
                                  "doc_id long, start long, end long, replacement string")
    trees = token_trees(edge, default_tokenizer())
    result = sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_after, r.n_edits, r.n_skipped)
                    for r in edited_counts(trees, default_tokenizer(), edits).collect())
    assert result == sorted([(1, 0, full(encode, "new text"), 1, 0), (2, 0, 0, 0, 0), (0, 3, 3, 0, 0),
                             (3, 3, full(encode, "q  c"), 2, 2), (3, 3, full(encode, "q  z"), 2, 2)])
    assert edited_counts(token_trees(edge.limit(0), default_tokenizer()), default_tokenizer(), rule=redactions).count() == 0


def test_batches_of_edits_one_after_the_other(monkeypatch):
    """A kept tree stands for the edited text: its counts stay those of a full encoding, batch after batch."""
    encode = encoder(default_tokenizer())
    rng = random.Random(9)
    for size in (1, 2, 5):
        monkeypatch.setattr("martspark.llm.edit_counts.LEAF_SEGMENTS", size)
        for _ in range(250):
            text = "".join(rng.choices(PARTS, k=rng.randint(0, 60)))
            tree = KeptTree.build(text, encode)
            for _ in range(5):
                edits = random_edits(rng, len(tree.text))
                expected, at = [], 0
                for start, end, new in sorted(edits):
                    expected += [tree.text[at:start], new]
                    at = end
                expected = "".join(expected) + tree.text[at:]
                tree.advance(edits, encode)
                assert tree.text == expected
                assert tree.total == full(encode, expected), (text, expected)
                assert tree.starts == sorted(tree.starts) and all(0 <= s <= len(expected) for s in tree.starts)


def test_trees_of_a_table_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two three four. " * 40), (2, None), (3, "")], "doc_id long, text string")
    edits = "doc_id long, start long, end long, replacement string"
    tokenizer, encode = default_tokenizer(), encoder(default_tokenizer())
    first = edited_trees(token_trees(docs, tokenizer), tokenizer,
                         spark.createDataFrame([(1, 0, 3, "many"), (2, 0, 0, "new words"), (1, 100, 104, None)], edits))
    second = edited_counts(first, tokenizer, spark.createDataFrame([(1, 4, 4, " more"), (2, 3, 3, "er"), (3, 0, 0, "x")], edits))
    after = {}
    for r in first.collect():
        after[r.doc_id] = r.text
    assert after[2] == "new words" and after[1].startswith("many two")
    expected = {1: "many more" + after[1][4:], 2: "newer words", 3: "x"}
    for r in second.collect():
        assert r.n_tokens == full(encode, after[r.doc_id]) and r.n_tokens_after == full(encode, expected[r.doc_id])


def test_redactions_equal_a_full_scan_and_cost_less():
    """Runs without an @ or a digit are not searched; those with one give what a scan of the whole text gives."""
    scan = lambda text: [(m.start(), m.end(), f"<{m.lastgroup}>") for m in REDACTED.finditer(text)]
    rng = random.Random(9)
    parts = ["a", "B", "1", "23", ".", "@", "-", "_", "+", " ", "\n", "é", "٣", "12345678", "abcdefghij", "1.2.3.4", "x@y.z", ",", "/"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(20_000)]
    assert all(redactions(text) == scan(text) for text in texts) and sum(map(len, map(scan, texts))) > 5_000
    text = "plain words without anything to hide, line after line\n" * 20_000 + "mail me@example.org now"
    begun = time.process_time()
    found = redactions(text)
    middle = time.process_time()
    assert found == scan(text) and len(found) == 1
    assert (middle - begun) * 3 < time.process_time() - middle
