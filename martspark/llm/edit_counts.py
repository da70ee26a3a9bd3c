"""Edit-aware token counts: a segment tree of pre-token runs per document, updated where edits touch it.

A text is cut where a pre-token is sure to begin (see ``bpe``); runs of
``LEAF_SEGMENTS`` such pieces are the leaves of a segment tree of token counts. An
edit re-encodes the leaves it touches and, where it touches the first two
characters of a leaf, the leaf before, since those two characters are what makes
the leaf's beginning a cut. All other counts stand. The re-encoded stretch keeps
the place of its first leaf, and sums are updated on the way to the root.

``token_trees`` gives the trees as a table beside the texts; ``edited_counts``
takes it with edits, from a table or from a rule that reads the text. Trees of
one document live in one row: a task holds a few rows at a time.

Defined results: a missing or empty text has a tree without leaves and no tokens,
and edits may still insert into it; edits are taken in order of their start, ones
that overlap an earlier edit or lie outside the text are counted as skipped;
documents without id are kept, and only a rule gives them edits; rows that repeat
an id get the same edits each; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.bpe import Encoder, encoder
from martspark.llm.common import batches

LEAF_SEGMENTS = 32

Edit = tuple[int, int, str]

# What the registered query redacts: mail addresses, numbers of eight digits and more, dotted addresses, long keys.
REDACTED = re.compile(
    r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<address>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<number>\b\d{8,}\b)"
    r"|(?P<key>\b(?=\w*\d)(?=\w*[A-Za-z])[A-Za-z0-9]{18,}\b)")

# Every match lies in a run of these characters, and has an @ or a digit in that run.
_HINT, _RUN = re.compile(r"[@\d]"), re.compile(r"[\w.+@-]+")


def redactions(text: str) -> list[Edit]:
    """Edits that put a tag in place of each piece of personal or secret data.

    Only runs with an @ or a digit are searched: the patterns cost many times a look for those.
    """
    found, at = [], 0
    while hint := _HINT.search(text, at):
        start = max(at, text.rfind(" ", at, hint.start()) + 1)
        at = _RUN.match(text, hint.start()).end()
        found += [(m.start(), m.end(), f"<{m.lastgroup}>") for m in REDACTED.finditer(text, start, at)]
    return found


class TokenTree:
    """Token counts of a text: ``starts`` of the leaves, and ``sums`` with the root at place 1."""

    def __init__(self, text: str, starts: list[int], sums: list[int]):
        self.text, self.starts, self.sums = text, starts, sums
        self.n_reencoded = self.n_skipped = self.n_edits = 0

    @classmethod
    def build(cls, text: str | None, encode: Encoder) -> TokenTree:
        text = text or ""
        pieces, ids = encode.pieces(text)
        starts, counts, at = [], [], 0
        for low in range(0, len(pieces), LEAF_SEGMENTS):
            starts.append(at)
            at += sum(map(len, pieces[low:low + LEAF_SEGMENTS]))
            counts.append(sum(map(len, ids[low:low + LEAF_SEGMENTS])) // 4)
        width = 1
        while width < len(counts):
            width *= 2
        sums = [0] * width + counts + [0] * (width - len(counts))
        for k in range(width - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return cls(text, starts, sums)

    @property
    def total(self) -> int:
        return self.sums[1]

    def _set(self, leaf: int, count: int) -> None:
        at = len(self.sums) // 2 + leaf
        change = count - self.sums[at]
        if len(self.sums) == 2:  # one leaf is the root itself
            self.sums[1] = count
            return
        while at and change:
            self.sums[at] += change
            at //= 2

    def _leaves(self, start: int, end: int) -> tuple[int, int]:
        """First and last leaf to encode anew for an edit of ``text[start:end]``."""
        from bisect import bisect_right

        first = max(0, bisect_right(self.starts, start) - 1)
        if first and start <= self.starts[first] + 1:
            first -= 1
        return first, max(first, bisect_right(self.starts, max(start, end - 1)) - 1)

    def apply(self, edits: list[Edit], encode: Encoder) -> str:
        """Apply edits, in places of the text before any of them; returns the new text."""
        regions: list[list] = []
        out, copied = [], 0
        for start, end, new in sorted(edits):
            if not copied <= start <= end <= len(self.text):
                self.n_skipped += 1
                continue
            out += [self.text[copied:start], new]
            copied = end
            self.n_edits += 1
            first, last = self._leaves(start, end)
            if regions and first <= regions[-1][1]:
                regions[-1][1] = max(last, regions[-1][1])
                regions[-1][2].append((start, end, new))
            else:
                regions.append([first, last, [(start, end, new)]])
        self.regions = regions
        for first, last, inside in regions:
            low = self.starts[first] if self.starts else 0
            high = self.starts[last + 1] if last + 1 < len(self.starts) else len(self.text)
            parts, at = [], low
            for start, end, new in inside:
                parts += [self.text[at:start], new]
                at = end
            part = "".join(parts) + self.text[at:high]
            self.n_reencoded += len(part)
            self._set(first, encode.count(part))
            for leaf in range(first + 1, last + 1):
                self._set(leaf, 0)
        return "".join(out) + self.text[copied:]


class KeptTree(TokenTree):
    """A tree that stands for the edited text after each batch of edits, so that the next one can start from it.

    Leaves that an edit merged into the one before stay as empty leaves at the end of it.
    """

    def _leaves(self, start: int, end: int) -> tuple[int, int]:
        first, last = super()._leaves(start, end)
        while first and start <= self.starts[first] + 1:  # an empty leaf gives no context
            first -= 1
        return first, last

    def advance(self, edits: list[Edit], encode: Encoder) -> None:
        """Apply edits and take over the new text."""
        text = self.apply(edits, encode)
        starts, moved, k = [], 0, 0
        merged = {first: (last, inside) for first, last, inside in self.regions}
        while k < len(self.starts):
            starts.append(self.starts[k] + moved)
            last, inside = merged.get(k, (k, ()))
            moved += sum(len(new) - (end - start) for start, end, new in inside)
            stop = self.starts[last + 1] if last + 1 < len(self.starts) else len(self.text)
            starts += [stop + moved] * (last - k)
            k = last + 1
        self.text, self.starts = text, starts or [0][:len(text)]


def token_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text, starts, sums`` per row of ``docs(doc_id, text)``."""

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for frame in batches(frames):
            trees = [TokenTree.build(text.as_py(), encode) for text in frame.column(1)]
            yield pa.record_batch(
                [frame.column(0), frame.column(1), pa.array([t.starts for t in trees], pa.list_(pa.int64())),
                 pa.array([t.sums for t in trees], pa.list_(pa.int64()))], names=["doc_id", "text", "starts", "sums"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, "doc_id long, text string, starts array<long>, sums array<long>")


def edited_counts(trees: DataFrame, tokenizer: str, edits: DataFrame | None = None,
                  rule: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """Counts before and after edits: ``doc_id, n_tokens, n_tokens_after, n_edits, n_skipped, n_leaves, n_chars,
    n_chars_encoded``.

    ``edits(doc_id, start, end, replacement)`` count code points of the stored text; ``rule`` reads them off it.
    """
    given = trees.select("doc_id", "text", "starts", "sums")
    from_table = edits is not None
    if from_table:
        listed = edits.filter("doc_id is not null").groupBy("doc_id").agg(
            F.collect_list(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("edits"))
        given = given.join(listed, "doc_id", "left")
    names = ["n_tokens", "n_tokens_after", "n_edits", "n_skipped", "n_leaves", "n_chars", "n_chars_encoded"]

    def update(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for frame in batches(frames):
            rows = []
            for k in range(frame.num_rows):
                tree = TokenTree(frame.column("text")[k].as_py() or "", frame.column("starts")[k].as_py(),
                                 frame.column("sums")[k].as_py())
                before = tree.total
                wanted = list(rule(tree.text)) if rule else []
                if from_table:
                    wanted += [tuple(e.values()) for e in frame.column("edits")[k].as_py() or []]
                if wanted:
                    tree.apply(wanted, encode)
                rows.append((before, tree.total, tree.n_edits, tree.n_skipped, len(tree.starts), len(tree.text), tree.n_reencoded))
            yield pa.record_batch([frame.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                                  names=["doc_id", *names])

    return given.mapInArrow(update, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def edited_trees(trees: DataFrame, tokenizer: str, edits: DataFrame | None = None,
                 rule: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """The trees after edits, ``doc_id, text, starts, sums``: a table to keep and to edit again.

    Edits are given as for ``edited_counts``, in places of the text that the tree holds. Of rows
    that share an id, each takes the edits of that id.
    """
    given = trees.select("doc_id", "text", "starts", "sums")
    from_table = edits is not None
    if from_table:
        listed = edits.filter("doc_id is not null").groupBy("doc_id").agg(
            F.collect_list(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("edits"))
        given = given.join(listed, "doc_id", "left")

    def update(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for frame in batches(frames):
            kept = []
            for k in range(frame.num_rows):
                tree = KeptTree(frame.column("text")[k].as_py() or "", frame.column("starts")[k].as_py(),
                                frame.column("sums")[k].as_py())
                wanted = list(rule(tree.text)) if rule else []
                if from_table:
                    wanted += [tuple(e.values()) for e in frame.column("edits")[k].as_py() or []]
                if wanted:
                    tree.advance(wanted, encode)
                kept.append(tree)
            yield pa.record_batch(
                [frame.column("doc_id"), pa.array([t.text for t in kept], pa.string()),
                 pa.array([t.starts for t in kept], pa.list_(pa.int64())), pa.array([t.sums for t in kept], pa.list_(pa.int64()))],
                names=["doc_id", "text", "starts", "sums"])

    return given.mapInArrow(update, "doc_id long, text string, starts array<long>, sums array<long>")
