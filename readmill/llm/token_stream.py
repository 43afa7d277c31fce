"""Token-id output: Arrow files of fixed-size-list batches, read back by memory map at any place without copying.

Documents are encoded where they are read; their ids are dealt to ranges of doc_id and sorted, and each range is one shard. A shard holds the ids of its documents,
an end id after each, cut into sequences of one length: `ids` (fixed-size list of the smallest unsigned type that holds the
vocabulary) and `mask` (fixed-size list of bool, false only in the padding that ends a shard). Beside it lies the list of
its documents (doc_id, place in the shard, number of ids). A shard is written under a name of its own attempt and then
renamed, so a repeated task leaves the same files. Only one small row for each shard goes to the driver.

Null and empty texts give the end id alone; null ids sort first; rows with one doc_id follow each other in order of a hash of
their text, which also spreads them over ranges; an empty table gives no shard and an empty result; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import map_batches, partitions, qualified, rows, shared_dir, utf8
from readmill.llm.pieces import opened

#: Sequences in one record batch.
BATCH = 64


#: Schemes that Hadoop and pyarrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def place(uri: str):
    """The file system and the path in it. The URI must be a qualified one (see common.qualified)."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or not rest.startswith("/"):
        raise ValueError(f"{uri}: without a scheme it would be each executor's own disk; qualify it first")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


class ShardWriter:
    """Ids in, batches of equal-length sequences out."""

    def __init__(self, uri: str, length: int, kind: pa.DataType):
        self.fs, self.path = place(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.tmp = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 4 * BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.empty(0, self.kind.to_pandas_dtype())
        step = BATCH * self.length
        whole = len(flat) if last else len(flat) // step * step
        for a in range(0, whole, step):
            some = flat[a : min(a + step, whole)]
            pad = -len(some) % self.length
            mask = np.ones(len(some) + pad, bool)
            mask[len(some) :] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.pad(some, (0, pad)), mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        self.fs.move(self.tmp, self.path)


class ShardReader:
    """Sequences by number and ids by place, as views of the mapped file where the file system allows a map."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        source = pa.memory_map(self.path) if self.fs.type_name == "local" else self.fs.open_input_file(self.path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> np.ndarray:
        return self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.file.get_batch(k // BATCH)
        return tuple(b.column(c)[k % BATCH].values.to_numpy(zero_copy_only=False) for c in ("ids", "mask"))

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        step = BATCH * self.length
        while n > 0:
            view = self.batch(start // step)[start % step :][:n]
            yield view
            start, n = start + len(view), n - len(view)


def bounds_of(docs: DataFrame, n: int) -> list[tuple[int | None, int]]:
    """The last (doc_id, hash of the text) of each of at most n ranges of about equal numbers of rows; null ids come first."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    dealt = keys.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "hash").groupBy(F.spark_partition_id().alias("part"))
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    ends = dealt.agg(F.max(first).alias("last")).select("last.*").collect()  # a row for each range
    return sorted(((r["doc_id"], r["hash"]) for r in ends), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))[:-1]


def write_stream(docs: DataFrame, vocabulary: str, end_id: int, directory: str, length: int = 2048) -> DataFrame:
    """Write the shards below `directory`. Returns shard, path, first (ids in the shards before it), n_tokens, n_docs."""
    spark, directory = docs.sparkSession, qualified(docs.sparkSession, directory)
    n_ranges = partitions(spark)
    bounds = [(i is not None, i or 0, h) for i, h in bounds_of(docs, n_ranges)]
    coded = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("ids", pa.binary())])
    head = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])
    out = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(vocabulary, "ids")
        end = np.array([end_id], coder.dtype(end_id)).tobytes()
        for batch in batches:
            keys = list(zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("hash").to_pylist()))
            ranges = [bisect_left(bounds, (i is not None, i or 0, h)) for i, h in keys]
            ids = [coder.ids(t, end_id) + end for t in utf8(batch, "text")]
            yield rows(coded, [ranges, [i for i, _ in keys], [h for _, h in keys], ids])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(opened(vocabulary, "ids").dtype(end_id))
        uri, writer, listed, n_docs, shard = None, None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = batch.column("range")[0].as_py()
                uri = f"{directory}/shard-{shard:06d}.arrow"
                writer = ShardWriter(uri, length, pa.from_numpy_dtype(kind))
                sink = writer.fs.open_output_stream(f"{writer.tmp}-docs")
                listed = pa.ipc.new_file(sink, head)
            ids = batch.column("ids").cast(pa.binary())
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            listed.write_batch(rows(head, [batch.column("doc_id"), (at[:-1] - at[0]) // kind.itemsize + writer.total, np.diff(at) // kind.itemsize]))
            writer.add(np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind))
            n_docs += batch.num_rows
        if writer is not None:
            listed.close()
            sink.close()
            writer.fs.move(f"{writer.tmp}-docs", f"{writer.path}-docs")
            writer.close()
            yield rows(out, [[shard], [uri], [writer.total], [n_docs]])

    keyed = map_batches(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), encode, "range int, doc_id long, hash long, ids binary")
    dealt = keyed.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("doc_id", "hash", "ids")
    shards = sorted(tuple(r) for r in map_batches(dealt, write, "shard long, path string, n_tokens long, n_docs long").collect())
    first, listed = 0, []
    for shard, path, n_tokens, n_docs in shards:
        listed.append((shard, path, first, n_tokens, n_docs))
        first += n_tokens
    return spark.createDataFrame(listed, "shard long, path string, first long, n_tokens long, n_docs long")


def read_stream(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = shards.sparkSession
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                reader = ShardReader(path)
                with reader.fs.open_input_file(f"{reader.path}-docs") as source:
                    listed = pa.ipc.open_file(source)
                    for k in range(listed.num_record_batches):
                        docs = listed.get_batch(k)
                        at, n = docs.column("place").to_pylist(), docs.column("n_tokens").to_pylist()
                        crcs = []
                        for a, m in zip(at, n):
                            crc = 0
                            for view in reader.span(a, m):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield rows(out, [docs.column("doc_id"), [first + a for a in at], n, crcs])

    return map_batches(shards.repartitionByRange(partitions(spark), "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    return read_stream(write_stream(docs, vocabulary, end_id, shared_dir(spark, "token-stream")))
