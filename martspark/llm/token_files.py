"""Token-id output: Arrow files of equal-length sequences and masks, with zero-copy random access.

Documents are dealt out by ranges of ``doc_id``; each task encodes its range and
writes one shard. A shard has two Arrow IPC files in the shared folder:

* ``<name>.arrow``: record batches of two fixed-size lists per row, ``ids``
  (``length`` integers, 16 bits where the vocabulary allows, else 32) and
  ``mask`` (``length`` booleans, false in the padding of the shard's last row).
  Every row has the same width, so sequence ``k`` of a shard lies at a place that
  follows from ``k`` alone and a memory map gives it without a copy or a parse.
* ``<name>.docs.arrow``: per document its id, the place of its first id in the
  shard and its number of ids.

A file's name carries an id of its own per attempt. The manifest, a table that
Spark commits, names the files of the attempts that succeeded, so a lost
executor or a repeated task leaves at most files nobody reads.

Defined results: a missing text is empty and gives only the end id; documents
with no id come first; rows that repeat an id are documents of their own, in the
order of their text's hash; an empty table gives a manifest without shards. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from martspark.llm.bpe import encoder
from martspark.session import working_path

SEQUENCE_LENGTH = 2048
END_ID = 0
ROWS_PER_BATCH = 256

MANIFEST = "shard int, file string, n_docs long, n_ids long, length int"


def _sequences_type(length: int, narrow: bool) -> pa.Schema:
    value = pa.uint16() if narrow else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(value, length), nullable=False),
                      pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)])


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a shared folder given as a URI or a plain path."""
    import pyarrow.fs

    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Streams ids into rows of equal length; holds one batch of rows at most, besides one document."""

    def __init__(self, fs, path: str, length: int, narrow: bool):
        self.schema = _sequences_type(length, narrow)
        self.dtype = np.dtype("<u2" if narrow else "<u4")
        self.length, self.sink = length, fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        width = self.length * ROWS_PER_BATCH
        if self.n_held >= width:
            joined = np.concatenate(self.held)
            whole = len(joined) // width * width
            for at in range(0, whole, width):
                self._batch(joined[at:at + width])
            self.held, self.n_held = [joined[whole:].copy()], len(joined) - whole

    def _batch(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self.length
        mask = np.ones(len(ids) + padding, dtype=bool)
        if padding:
            mask[len(ids):] = False
            ids = np.concatenate([ids, np.zeros(padding, self.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (ids, mask)]
        columns = [column.cast(field.type) for column, field in zip(columns, self.schema)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        """All batches but the last have the same number of rows, as readers rely on."""
        if self.n_held:
            self._batch(np.concatenate(self.held))
        self.writer.close()
        self.sink.close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, length: int = SEQUENCE_LENGTH,
                      end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards below ``path``; returns the committed manifest.

    ``shards`` defaults to the session's shuffle partitions, which a cluster sizes
    to its data.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = posixpath.join(path, "shards")
    fs, local = filesystem(folder)
    fs.create_dir(local, recursive=True)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_ids = encoder(tokenizer)
        narrow = encode_ids.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        out, base = filesystem(folder)
        writer = None
        doc_ids: list = []
        counts: list[int] = []
        for frame in frames:
            doc_ids += frame.column(0).to_pylist()
            for ids, sizes in encode_ids.batch(frame.column(1)):
                if writer is None:
                    writer = _ShardWriter(out, f"{base}/{name}.arrow", length, narrow)
                writer.add(np.insert(ids, np.cumsum(sizes), np.uint32(end_id)))
                counts += (sizes + 1).tolist()
        if writer is None:
            return
        writer.close()
        sizes = np.array(counts, dtype=np.int64)
        table = pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)],
                                schema=DOCS_SCHEMA)
        with out.open_output_stream(f"{base}/{name}.docs.arrow") as sink, pa.ipc.new_file(sink, DOCS_SCHEMA) as index:
            index.write_batch(table)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(counts), "n_ids": int(sizes.sum()),
                                           "length": length}],
                                         schema=pa.schema([("shard", pa.int32()), ("file", pa.string()),
                                                           ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                                                           ("length", pa.int32())]))

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )
    manifest = posixpath.join(path, "manifest")
    ordered.mapInArrow(encode, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


class ShardReader:
    """Random access to a shard's sequences; a local file is mapped, not read."""

    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        local = type(fs).__name__ == "LocalFileSystem"
        self._open = (lambda p: pa.memory_map(p)) if local else (lambda p: fs.open_input_file(p))
        self.sequences = pa.ipc.open_file(self._open(f"{base}/{name}.arrow"))
        self.documents = pa.ipc.open_file(self._open(f"{base}/{name}.docs.arrow"))
        self.length = self.sequences.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """All ids of a batch as one flat view, and its mask."""
        batch = self.sequences.get_batch(k)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        k, at = divmod(row, ROWS_PER_BATCH)
        ids, mask = self.batch(k)
        part = slice(at * self.length, (at + 1) * self.length)
        return ids[part], mask[part].to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` on."""
        width = self.length * ROWS_PER_BATCH
        first, last = start // width, (start + n - 1) // width
        parts = [self.batch(k)[0] for k in range(first, last + 1)] if n else [np.zeros(0, np.uint16)]
        joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return joined[start - first * width:start - first * width + n]


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` and the shard it lies in.

    A shard's place in the whole is the sum of the shards before it: one manifest
    row per shard, so that window is as small as the number of shards.
    """
    folder = posixpath.join(path, "shards")
    manifest = spark.read.schema(MANIFEST).parquet(posixpath.join(path, "manifest"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    placed = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")

    def digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                reader = ShardReader(folder, row["file"])
                for k in range(reader.documents.num_record_batches):
                    docs = reader.documents.get_batch(k)
                    starts, sizes = (docs.column(i).to_numpy() for i in (1, 2))
                    crcs = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield pa.record_batch(
                        [docs.column(0), pa.array(starts + row["base"]), docs.column(2), pa.array(crcs, pa.int64()),
                         pa.array(np.full(len(crcs), row["shard"]), pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return placed.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_digests(docs: DataFrame, tokenizer: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Write the documents' token files to the shared folder and read the digests back from them."""
    spark = docs.sparkSession
    path = working_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, length)
    return read_token_digests(spark, path)
