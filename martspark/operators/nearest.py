"""Exact nearest neighbours by cosine, as a blocked matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martspark.functions.vectors import unit_vector

BLOCK_ROWS, BLOCK_VALUES = 8_192, 1 << 23  # rows of a block at least, numbers sent in it at most
SPARSE = 0.25  # share of numbers that are not zero up to which vectors are sent without their zeros
QUERY_ROWS, TILE_ROWS = 512, 1_024  # bound the dense result held at a time: it stays in a core's cache
CELLS_PER_CORE = 4
PROBE_ROWS = 256  # rows that tell how large a block's rows are
DECIMALS = 12  # similarities are compared to this many decimals, so equal vectors tie


def _block_rows(queries: int, corpus: int, width: int, cores: int) -> int:
    """Rows of a block: each side is sent once per block of the other, so blocks are as large as memory and cores allow."""
    spread = int(np.sqrt(queries * corpus / (CELLS_PER_CORE * cores)))
    return max(BLOCK_ROWS, min(spread, BLOCK_VALUES // max(width, 1)))


def _dense_best(similarity: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``take`` largest per row, larger first, then by column."""
    limit = np.partition(similarity, similarity.shape[1] - take, axis=1)[:, [similarity.shape[1] - take]]
    # Of the values equal to the last place's, those in the lower columns fill the places that are left.
    above, equal = similarity > limit, similarity == limit
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= take - above.sum(axis=1, keepdims=True)))
    picked = np.nonzero(chosen)[1].reshape(len(similarity), take)
    values = np.take_along_axis(similarity, picked, axis=1)
    inside = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(picked, inside, axis=1), np.take_along_axis(values, inside, axis=1)


def best_columns(vectors: np.ndarray, items: "np.ndarray | SparseRows", take: int, own: tuple[np.ndarray, np.ndarray] | None = None,
                 small: np.ndarray | None = None, tile_rows: int = TILE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the ``take`` best items of every vector; both are of unit length at most.

    The first tile of items is ranked as a whole. From then on a row has a last place to beat: a product in
    single precision, whose error is bounded, finds what may beat it, and only that is computed exactly.
    Pairs in ``own`` (rows, columns) take no part.
    """
    first = items[:tile_rows]
    similarity = np.round(vectors @ first.T, DECIMALS)
    if own is not None:
        inside = own[1] < len(first)
        similarity[own[0][inside], own[1][inside]] = -np.inf
    columns, values = _dense_best(similarity, min(take, len(first)))
    rows = np.repeat(np.arange(len(vectors)), columns.shape[1])
    columns, floor, values = columns.ravel(), values[:, -1].copy(), values.ravel()
    if len(items) == len(first):
        return rows, columns, values
    if columns.size < take * len(vectors):
        floor[:] = -np.inf
    slack = 4 * (items.shape[1] + 8) * np.finfo(np.float32).eps
    vectors32 = vectors.astype(np.float32)
    limit = (floor - slack).astype(np.float32)
    near = np.empty((len(vectors), tile_rows), np.float32)
    waiting, held = [(rows, columns, values)], 0
    for start in range(len(first), len(items), tile_rows):
        tile = items[start:start + tile_rows].astype(np.float32) if small is None else small[start:start + tile_rows]
        if len(tile) < tile_rows:
            near = np.empty((len(vectors), len(tile)), np.float32)
        np.matmul(vectors32, tile.T, out=near)
        if own is not None:
            inside = (own[1] >= start) & (own[1] < start + tile_rows)
            near[own[0][inside], own[1][inside] - start] = -np.inf
        some = np.flatnonzero(near.max(axis=1) > limit)
        if not len(some):
            continue
        r, c = np.divmod(np.flatnonzero(near[some] > limit[some, None]), len(tile))
        r = some[r]
        if len(r) * 16 > near.size:
            exact = (vectors @ items[start:start + tile_rows].T)[r, c]
        else:
            exact = np.einsum("ij,ij->i", vectors[r], items[start + c])
        exact = np.round(exact, DECIMALS)
        beats = exact > floor[r]  # an equal value in a later column has the higher id
        waiting.append((r[beats], start + c[beats], exact[beats]))
        held += len(waiting[-1][0])
        # Until enough have come to be worth a sort the last places stay as they are: more pass, none is lost.
        if held > take * len(vectors):
            waiting, held = [_best_of(waiting, len(vectors), take, floor)], 0
            limit = (floor - slack).astype(np.float32)
    return _best_of(waiting, len(vectors), take, floor)


def _best_of(found: list, n: int, take: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``take`` best of every row among (rows, columns, values); raises ``floor`` to the last place of full rows."""
    rows, columns, values = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((columns, -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    rows, columns, values, place = (x[place < take] for x in (rows, columns, values, place))
    last = place == take - 1
    floor[rows[last]] = values[last]
    return rows, columns, values


def _own_pairs(ids, item_ids) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of equal ids; a missing id equals none."""
    codes, _ = pd.factorize(np.concatenate([ids, item_ids]))
    mine, theirs = codes[:len(ids)], codes[len(ids):]
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
    many = np.where(mine >= 0, high - low, 0)
    rows = np.repeat(np.arange(len(ids)), many)
    return rows, order[np.repeat(low, many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)]


class SparseRows:
    """Rows without their zeros; indexing makes those that are asked for whole."""

    def __init__(self, width: int, sizes: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.shape, self.sizes, self.starts = (len(sizes), width), sizes, np.cumsum(sizes) - sizes
        self.places, self.values = places, values

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, which: slice | np.ndarray) -> np.ndarray:
        sizes, starts = self.sizes[which], self.starts[which]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(rows)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        whole = np.zeros((len(sizes), self.shape[1]))
        whole[rows, self.places[at]] = self.values[at]
        return whole


def packed(df: DataFrame, key: str) -> DataFrame:
    """``key, width, places, numbers``: vectors as bytes; where few numbers are not zero only these, with their places."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            lists = frame.column("vector")
            width = len(lists[0]) if lists[0].is_valid else 0
            if lists.null_count or not np.array_equal(np.diff(lists.offsets.to_numpy()), np.full(len(lists), width)):
                raise ValueError("a vector is missing or has another length")
            numbers = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            used, places = numbers != 0, None
            if used.mean() <= SPARSE:
                sizes = used.sum(axis=1)
                places = _bytes_column(np.nonzero(used)[1].astype(np.int32), sizes)
                values = _bytes_column(numbers[used], sizes)
            else:
                values = _bytes_column(np.ascontiguousarray(numbers).ravel(), np.full(len(numbers), width))
            places = pa.nulls(len(numbers), pa.binary()) if places is None else places
            yield pa.record_batch([frame.column(key), pa.array(np.full(len(numbers), width, np.int32)), places, values],
                                  names=[key, "width", "places", "numbers"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "vector").mapInArrow(pack, f"{key} {kind}, width int, places binary, numbers binary")


def _bytes_column(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def unpacked(rows: pd.DataFrame) -> np.ndarray | SparseRows:
    """The vectors of ``packed`` rows, whole where they were sent whole."""
    width = int(rows["width"].iloc[0])
    if (rows["width"] != width).any():
        raise ValueError("vectors have several lengths")
    values = np.frombuffer(b"".join(rows["numbers"]))
    if rows["places"].isna().all():
        return values.reshape(-1, width)
    every = np.arange(width, dtype=np.int32).tobytes()
    places = np.frombuffer(b"".join(every if x is None else x for x in rows["places"]), np.int32)
    return SparseRows(width, np.fromiter(map(len, rows["numbers"]), np.int64, len(rows)) // 8, places, values)


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, block_rows: int | None = None
) -> DataFrame:
    """The ``k`` most similar corpus rows of every query: query_id, item_id, similarity, position.

    Inputs are ``(query_id, vector)`` and ``(item_id, vector)``. Both sides are
    cut into blocks by a hash of the id, so a block's size does not depend on the
    data's shape. Vectors are sent as bytes, without their zeros where these are most. A task multiplies one query block with one corpus block and
    returns only that block's ``k`` best per query; the blocks' winners are then
    merged per query. Nothing is skipped, so the result is exact; ties go to the
    lower id. Without ``block_rows`` a block has as many rows as its numbers in memory and the cores allow.
    """
    counts = queries.count(), corpus.count()
    left, right = (packed(df.select(key, unit_vector(F.col("vector")).alias("vector")), key)
                   for df, key in ((queries, "query_id"), (corpus, "item_id")))
    if block_rows is None:
        sent = F.coalesce(F.length("places"), F.lit(0)) + F.length("numbers")
        size = right.limit(PROBE_ROWS).agg(F.ceil(F.avg(sent) / 8)).first()[0]
        block_rows = _block_rows(*counts, size or 1, corpus.sparkSession.sparkContext.defaultParallelism)
    query_blocks, corpus_blocks = (max(1, -(-n // block_rows)) for n in counts)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = left.withColumn("q", dealt("query_id", query_blocks)).withColumn("c", spread(corpus_blocks))
    right = right.withColumn("c", dealt("item_id", corpus_blocks)).withColumn("q", spread(query_blocks))
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *corpus.schema.fields]}

    def multiply(query_rows: pd.DataFrame, item_rows: pd.DataFrame) -> pd.DataFrame:
        if query_rows.empty or item_rows.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "item_id", "similarity")})
        item_rows = item_rows.sort_values("item_id", ignore_index=True)
        query_ids, item_ids = query_rows["query_id"].to_numpy(), item_rows["item_id"].to_numpy()
        items, asked, parts = unpacked(item_rows), unpacked(query_rows), []
        small = None if isinstance(items, SparseRows) else items.astype(np.float32)
        for start in range(0, len(query_ids), QUERY_ROWS):
            ids = query_ids[start:start + QUERY_ROWS]
            vectors = asked[start:start + QUERY_ROWS]
            own = _own_pairs(ids, item_ids) if exclude_self else None
            rows, columns, values = best_columns(vectors, items, min(k, len(item_ids)), own, small)
            found = values > -np.inf
            parts.append(pd.DataFrame({"query_id": ids[rows[found]], "item_id": item_ids[columns[found]], "similarity": values[found]}))
        return pd.concat(parts)

    schema = f"query_id {types['query_id']}, item_id {types['item_id']}, similarity double"
    winners = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(multiply, schema)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return winners.withColumn("position", F.row_number().over(by_query)).filter(F.col("position") <= k)
