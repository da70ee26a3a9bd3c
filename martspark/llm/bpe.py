"""Byte-pair token ids of whole texts, with the ids of recurring segments kept in memory.

The vocabulary's pre-tokenizer always starts a new pre-token at a space that a
non-space character follows, whatever stands before it, and merges never cross
pre-tokens. A text cut at those places can therefore be encoded piece by piece
with the same ids; letters with one mark behind are two pre-tokens. Pieces recur a
lot, so each is handed to the tokenizers library once and its ids are kept, in
arrays: about 40 bytes a piece, ``KEPT_SEGMENTS`` of them. What is not kept is encoded
again, which changes no id. A piece is known by a 128-bit hash.

Whole batches go through ``Encoder.batch``: texts are cut and their pieces numbered by
Arrow, each distinct piece is looked up once, all that are missing are encoded in one
call, and ids are put in order by array operations.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

KEPT_SEGMENTS = 1_500_000
SINGLE_SEGMENTS, SINGLE_LENGTH = 250_000, 64
SLICE_BYTES = 8 << 20
MARKS = ".,;:!?"

_ODD_SPACES = re.compile(r" (?=\s)| $")
_ODD_SPACES_ARROW = r" [\s\v\x1c-\x1f\x{85}\p{Z}]| $"  # the same, spelled for Arrow's patterns
_CUT = re.compile(r"(?= \S)")


def segments(text: str) -> list[str]:
    """Cut before every space that a non-space follows; the pieces join to the text."""
    if not text:
        return []
    if _ODD_SPACES.search(text):
        return [piece for piece in _CUT.split(text) if piece]
    head, *rest = text.split(" ")
    pieces = [" " + piece for piece in rest]
    return [head, *pieces] if head else pieces


class _Kept:
    """Ids of pieces by the hash of the piece: sorted arrays and one pool of ids."""

    def __init__(self):
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.n_ids = np.zeros(1 << 12, "<u4"), 0

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not kept."""
        if not len(self.low):
            return np.full(len(low), -1)
        at = np.minimum(np.searchsorted(self.low, low), len(self.low) - 1)
        return np.where((self.low[at] == low) & (self.high[at] == high), at, -1)

    def add(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Hashes that are not kept yet, with their ids one after the other."""
        while self.n_ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        self.pool[self.n_ids:self.n_ids + len(ids)] = ids
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)
        low = np.concatenate([self.low, low])
        order = np.argsort(low, kind="stable")
        self.low, self.high = low[order], np.concatenate([self.high, high])[order]
        self.start, self.size = np.concatenate([self.start, starts])[order], np.concatenate([self.size, sizes])[order]


def _hashed(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    values = np.array(pieces, dtype=object)
    low, high = (pd.util.hash_array(values, hash_key=key, categorize=False) for key in ("0123456789abcdef", "fedcba9876543210"))
    return low, high


class Encoder:
    """Ids of texts under a tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = _Kept()
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of all pieces, and the ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((x for ids in found for x in ids), "<u4", int(sizes.sum()))

    def of_distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids and, per piece, where its ids begin and how many they are; pieces must differ."""
        if not pieces:
            return self.kept.pool, np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = _hashed(pieces)
        at = self.kept.find(low, high)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.kept.pool, self.kept.start[at], self.kept.size[at]
        sizes, ids = self._learn([pieces[k] for k in missing.tolist()])
        if len(self.kept.low) + len(missing) <= KEPT_SEGMENTS:
            self.kept.add(low[missing], high[missing], sizes, ids)
            at = self.kept.find(low, high)
            return self.kept.pool, self.kept.start[at], self.kept.size[at]
        # No room: these ids are used once, behind the pool's own.
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        there = at >= 0
        start[there], size[there] = self.kept.start[at[there]], self.kept.size[at[there]]
        start[missing], size[missing] = self.kept.n_ids + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([self.kept.pool[:self.kept.n_ids], ids]), start, size

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of the pieces of a single text; the first ``SINGLE_SEGMENTS`` short ones are kept in a table of their own."""
        known = self.known
        ids = list(map(known.get, pieces))
        if None in ids:
            fresh = self._missing({piece for piece, found in zip(pieces, ids) if found is None})
            ids = [fresh[piece] if found is None else found for piece, found in zip(pieces, ids)]
            room = SINGLE_SEGMENTS - len(known)
            if room > 0:
                known.update(islice(((p, v) for p, v in fresh.items() if len(p) <= SINGLE_LENGTH), room))
        return ids

    def _missing(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not kept; letters with one mark behind are put together from both."""
        known = self.known
        parts = {p: (p[:-1], p[-1]) for p in pieces if p[-1] in MARKS and p[0] == " " and p[1:-1].isalpha()}
        wanted = [p for p in pieces if p not in parts]
        wanted += {part for pair in parts.values() for part in pair if part not in known}.difference(pieces)
        encoded = self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False)
        fresh = {piece: array("I", e.ids).tobytes() for piece, e in zip(wanted, encoded)}
        for piece, (word, mark) in parts.items():
            fresh[piece] = (known.get(word) or fresh[word]) + (known.get(mark) or fresh[mark])
        return fresh

    def pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        """The text's segments and the ids of each."""
        cut = segments(text)
        return cut, self.of_pieces(cut)

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts one after the other, and how many each text has, in bounded slices."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield self._slice(texts.slice(at, end - at))
            at = end

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD_SPACES_ARROW).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        cut = pc.split_pattern(plain, " ")
        starts = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        words, marks = _parted(names)
        base = pc.if_else(words.is_valid(), words, names).dictionary_encode()  # a word with and without its mark is one piece
        spaced = [f" {name}" for name in base.dictionary.to_pylist()]
        first = base.indices.to_numpy().astype(np.int64)
        # The piece before the first space has none in front of it; texts that are cut otherwise have their own pieces.
        heads = [names[k].as_py() for k in code[starts[:-1]].tolist()]
        whole = {int(k): segments(texts[int(k)].as_py()) for k in np.flatnonzero(odd)}
        known = set(spaced)
        extra = [*filter(None, heads), *(piece for pieces in whole.values() for piece in pieces), *MARKS]
        extra = [piece for piece in dict.fromkeys(extra) if piece not in known]
        pool, start, size = self.of_distinct([*spaced, *extra])
        start, size = np.append(start, 0), np.append(size, 0)  # the last piece has no ids
        nothing = len(size) - 1
        place = {piece: len(spaced) + k for k, piece in enumerate(extra)}
        at = {piece: k for k, piece in enumerate(spaced)} if whole else {}
        second = np.where(marks >= 0, np.array([place[m] for m in MARKS])[marks], -1)
        # One entry per piece, two where a mark follows.
        entry, follows = first[code], second[code]
        entry[starts[:-1]] = [place[head] if head else nothing for head in heads]
        follows[starts[:-1]] = -1
        if whole:
            parts, after = np.split(entry, starts[1:-1]), np.split(follows, starts[1:-1])
            for k, pieces in whole.items():
                parts[k] = np.array([place.get(piece, at.get(piece)) for piece in pieces], np.int64)
                after[k] = np.full(len(pieces), -1)
            starts = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
            entry, follows = np.concatenate(parts), np.concatenate(after)
        count = 1 + (follows >= 0)
        ends = np.cumsum(count)
        entries = np.repeat(entry, count)
        entries[ends[follows >= 0] - 1] = follows[follows >= 0]
        lengths = size[entries]
        stops = np.cumsum(lengths)
        moved = np.repeat(start[entries] - (stops - lengths), lengths)
        flat = pool[moved + np.arange(len(moved))]
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], ends])[starts]]
        return flat, np.diff(bounds)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text (none for a missing one)."""
        return b"".join(self.pieces(text)[1]) if text else b""

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4


def _parted(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Letters with one mark behind: the letters (null for other pieces) and the mark's number (-1)."""
    split = pc.match_substring_regex(names, r"^\p{L}+[" + MARKS + "]$")
    words = pc.if_else(split, pc.utf8_slice_codeunits(names, 0, -1), None)
    last = pc.index_in(pc.utf8_slice_codeunits(names, -1), value_set=pa.array(list(MARKS)))
    return words, np.where(split.to_numpy(zero_copy_only=False), pc.fill_null(last, -1).to_numpy(), -1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    """The public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
