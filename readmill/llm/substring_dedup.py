"""Substring dedup with a log-structured fingerprint index.

Every window of `window` words has an anchor: the least hash among the `gram`-word sequences inside it. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so a document has about one anchor for every four words. The
index holds anchors of all documents seen so far in immutable runs: for each range of the hash a sorted array, as differences.
A batch of documents becomes sorted segments (one for each task), which are merge-joined, range by range, with the runs;
what is new becomes a run of its own, and the anchors found again are marked as shared. From `fan` runs on, the merge writes
one compacted run in place of all.

Anchors only nominate. Windows with a shared anchor are then verified as wholes, by a 64-bit hash of all their words: the
first document of each is found by aggregation, and words under a window that also starts in an earlier document go.

A null or empty text has no words. Rows that share a doc_id are judged alike: neither removes words from the other. A null
doc_id is before all others. Documents that are equal as a whole to an earlier one are settled by that. Very long texts are
hashed as wholes. An empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import forget, map_batches, rows, utf8, window_hashes, word_hashes, written
from readmill.llm.quality import covered

WINDOW, GRAM = 13, 6
BITS = 48
#: Anchors that a task gathers before it emits a segment, and that a range of the index is meant to hold.
SEGMENT, RANGE = 500_000, 500_000
NO_ID = -(1 << 63)
_MASK, _ODD = np.uint64((1 << BITS) - 1), np.uint64(0x9E3779B97F4B)


def spread(least: np.ndarray) -> np.ndarray:
    """A bijection on numbers of BITS bits: least hashes are small ones, and the ranges of the index are to be equal."""
    x = least * _ODD & _MASK
    x ^= x >> np.uint64(BITS // 2)
    return x * _ODD & _MASK


def anchors(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hashes of the words."""
    h = word_hashes(text)
    least, have = window_hashes(h, gram) >> np.uint64(64 - BITS), 1
    n = window - gram + 1
    if len(least) < n:
        return least[:0], h
    while have < n:  # the least of twice as many, or of as many as are still missing
        step = min(have, n - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return spread(least), h


def packed(values: np.ndarray) -> bytes:
    """Sorted different values as differences, in 4 bytes each where these do."""
    steps = np.diff(values, prepend=np.uint64(0))
    wide = len(steps) and int(steps.max()) >> 32
    return (b"\x08" if wide else b"\x04") + steps.astype("<u8" if wide else "<u4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u8" if blob[0] == 8 else "<u4", offset=1).astype(np.uint64), dtype=np.uint64)


_SEGMENT = "range int, run boolean, anchors binary, shared binary"
_OUT = pa.schema([("range", pa.int32()), ("run", pa.bool_()), ("anchors", pa.binary()), ("shared", pa.binary())])


def segments(docs: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """Sorted segments of the documents' anchors. shared: those that several documents of the segment have."""
    shift = np.uint64(BITS - (ranges.bit_length() - 1))

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(parts)
        parts.clear()
        values.sort()
        first = np.r_[True, values[1:] != values[:-1]]
        again = np.r_[~first[1:], False][first]  # whether the next one is equal
        values = values[first]
        at = np.searchsorted(values >> shift, np.arange(ranges + 1))
        cut = [(k, a, b) for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if b > a]
        return rows(_OUT, [[k for k, _, _ in cut], [False] * len(cut), [packed(values[a:b]) for _, a, b in cut], [packed(values[a:b][again[a:b]]) for _, a, b in cut]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in utf8(batch, "text"):
                parts.append(np.unique(anchors(text, window, gram)[0]))
                held += len(parts[-1])
                if held >= SEGMENT:
                    yield emit(parts)
                    held = 0
        if held:
            yield emit(parts)

    return map_batches(docs.select("text"), run, _SEGMENT)


class Index:
    """The runs, each a table of (range, anchors, shared) in the shared folder."""

    def __init__(self, ranges: int, window: int = WINDOW, gram: int = GRAM, fan: int = 3):
        self.ranges, self.window, self.gram, self.fan = ranges, window, gram, fan
        self.runs: list[DataFrame] = []

    def add(self, docs: DataFrame, compact: bool = False) -> None:
        """Merge-join a batch with the runs; its new and its shared anchors become a run, or with all others one."""
        compact = compact or len(self.runs) + 1 >= self.fan
        new = segments(docs, self.ranges, self.window, self.gram)
        held = reduce(DataFrame.unionByName, [new, *(r.withColumn("run", F.lit(True)) for r in self.runs)])

        def merge(table: pa.Table) -> pa.Table:
            run, values, shared = (table.column(c).to_pylist() for c in ("run", "anchors", "shared"))
            old = [unpacked(v) for r, v in zip(run, values) if r]
            got = [unpacked(v) for r, v in zip(run, values) if not r]
            here, count = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, int))
            past = np.sort(np.concatenate(old)) if old else here[:0]
            known = np.isin(here, past, assume_unique=True)
            marked = [here[known | (count > 1)]] + [unpacked(s) for r, s in zip(run, shared) if not r or compact]
            keep = [here[~known]] + ([past] if compact else [])
            return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "anchors": [packed(np.sort(np.concatenate(keep)))], "shared": [packed(np.unique(np.concatenate(marked)))]})

        run = written(held.groupBy("range").applyInArrow(merge, "range int, anchors binary, shared binary"), "anchor-run")
        if compact:
            for r in self.runs:
                forget(r)
            self.runs = []
        self.runs.append(run)

    def shared(self) -> DataFrame:
        """anchor: those that several documents have, each once (after compaction)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("shared").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(unpacked(blob).astype(np.int64))], names=["anchor"])

        return map_batches(reduce(DataFrame.unionByName, self.runs).select("shared"), run, "anchor long")


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n batches of about equal numbers, in order of doc_id."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000).alias("at")).first()["at"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        inside = F.lit(True)
        if a is not None:
            inside &= F.col("doc_id") > a
        if b is not None:
            inside &= F.col("doc_id") <= b
        out.append(docs.where(inside))
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by blanks) and, if asked for, kept, of each document."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = 1 << max(3, min(24, int(n_bytes / 6 * 0.25 / RANGE).bit_length()))
    index = Index(ranges, window, gram)
    parts = batches_of(docs, batches)
    for k, part in enumerate(parts):
        index.add(part, compact=k == len(parts) - 1)

    def occurrences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [np.unique(anchors(t, window, gram)[0]) for t in utf8(batch, "text")]
            if found:
                ids = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(ids)], names=["anchor", "doc_id"])

    def squeezed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([squeeze(t) for t in utf8(batch, "text")], pa.binary())], names=["doc_id", "squeezed"])

    shared = map_batches(docs, occurrences, "anchor long, doc_id long").join(index.shared(), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    copies = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    firsts = copies.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = copies.join(firsts, "sha").where("doc_id > first").select("doc_id", F.sha2("sha", 256).alias("copied"))
    # which texts of a doc_id are copies is told by the digest of their digest
    told = copies.groupBy("doc_id").agg(F.collect_set("copied").alias("copies")).join(shared, "doc_id", "full")
    told = written(told, "shared-anchors")
    known = map_batches(docs, squeezed, "doc_id long, squeezed binary").join(told, "doc_id", "left")

    def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bool, np.ndarray]]:
        open_ = zstandard.ZstdDecompressor().decompress
        wanted = batch.column("anchors")
        for k, (doc_id, z, copies) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("squeezed").to_pylist(), batch.column("copies").to_pylist())):
            t = open_(z) if z else b""
            sha = hashlib.sha256(hashlib.sha256(t).hexdigest().encode()).hexdigest() if copies else None
            yield doc_id, t, bool(copies) and sha in copies, wanted[k].values.to_numpy().astype(np.uint64) if wanted[k].is_valid else np.empty(0, np.uint64)

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, found = [], []
            for doc_id, t, copied, wanted in texts(batch):
                if not copied and len(wanted):
                    a, h = anchors(t, window, gram)
                    found.append(np.unique(window_hashes(h, window)[np.isin(a, wanted)]))
                    ids.append(np.full(len(found[-1]), doc_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], names=["hash", "doc_id"])

    windows = map_batches(known.where("anchors is not null"), candidates, "hash long, doc_id long")
    firsts = windows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    removed = windows.join(firsts, "hash").where("doc_id > first").groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))
    columns = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * text
    out = pa.schema(columns)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done, gone = [], batch.column("hashes")
            for k, (doc_id, t, copied, _) in enumerate(texts(batch)):
                words = t.split()
                n = len(words)
                if copied and n >= window:
                    words = []
                elif gone[k].is_valid and n >= window:
                    starts = np.isin(window_hashes(word_hashes(t), window), gone[k].values.to_numpy().view(np.uint64))
                    under = covered(starts, window, n)
                    words = [w for w, x in zip(words, under.tolist()) if not x]
                kept = b" ".join(words)
                done.append((None if doc_id == NO_ID else doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if text else [])))
            yield rows(out, list(zip(*done)) or [[] for _ in out])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    return map_batches(known.join(removed, "doc_id", "left"), keep, schema)
