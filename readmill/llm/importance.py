r"""Importance resampling towards a target distribution, by an external sort of hashed features.

Words are runs of characters other than ASCII signs and white space, with A to Z in lower case. A feature is a run of 1 to `longest` words joined by one space; its bucket
is the CRC-32 of its UTF-8 bytes modulo BUCKETS. Texts are read once: their buckets are written as packed streams of 16-bit numbers, each a record with
the offsets of its documents, to the shared folder. Each stream is then sorted and run-length encoded; runs of a task are merged as they come, so a task holds
at most a few thousand of them and hands on a row for each bucket. From the counts of the corpus and of the target follows a gain for each bucket,
floor(1000 * ln of the ratio of the two smoothed shares), and a document's weight is the sum of its features' gains, gathered from the
streams with np.add.reduceat. A Gumbel number drawn from a hash of the id makes the order of scores a draw without replacement; the highest scores are drawn.

Scores are ordered by ranges over the cluster; a row's rank is its place in a range on top of the rows of the ranges before it. The driver sees a row for each bucket and
none of documents. A task that is lost is run again from the texts or from the streams.

Null and empty texts, and texts without words, have no features and a weight of 0. Texts of any length are hashed in stretches of PIECE bytes, so memory follows their
streams (two bytes a word). A null id hashes as an empty one and comes after all ids among equal scores; rows that share an id are documents of their own, and
come in order of their features' number among equal scores. Without eligible documents nothing is drawn, and an empty table gives an empty result. Further
columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readmill.llm.common import map_batches, partitions, rows, utf8, written

#: At most 65536, as streams hold numbers of 16 bits.
BUCKETS = 10_000
PIECE = 1 << 20
#: Runs that a task holds before it merges them.
HELD = 1 << 18

_letters = bytes(range(ord("a"), ord("z") + 1))
_keep = set(b"0123456789") | set(_letters) | set(range(0x80, 0x100))
#: Each byte in lower case if it belongs to words, else a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c in _keep else 32 for c in range(256))

STREAM = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("buckets", pa.binary())])
STREAM_DDL = "doc_id array<long>, n_words array<long>, ends array<long>, buckets binary"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case, some at a time."""
    a = 0
    while a < len(text):
        b, part = a + PIECE, text[a : a + PIECE].translate(WORD_BYTES)
        while b < len(text) and (cut := part.rfind(b" ")) < 0:  # a word longer than a piece
            part += text[b : b + PIECE].translate(WORD_BYTES)
            b += PIECE
        if b < len(text):
            part = part[:cut]
            a += cut + 1
        else:
            a = len(text)
        yield part.split()


def buckets_of(text: bytes, longest: int, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of a text's features, and its number of words."""
    found, n_words, carried = [], 0, []
    for words in words_of(text):
        n_words += len(words)
        found.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets)
        if longest > 1:
            run = carried + words
            for n in range(2, longest + 1):
                ahead = run[max(0, len(carried) - n + 1) :]
                grams = [b" ".join(ahead[i : i + n]) for i in range(len(ahead) - n + 1)]
                found.append(np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)) % buckets)
            carried = run[1 - longest :]
    return (np.concatenate(found) if found else np.empty(0)).astype("<u2"), n_words


def streams(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The packed streams of a table of doc_id and text: ids, numbers of words, where each document's features end, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets_of(t, longest, buckets) for t in utf8(batch, "text")]
            ends = np.cumsum([len(b) for b, _ in found])
            packed = b"".join(b.tobytes() for b, _ in found)
            yield rows(STREAM, [[batch.column("doc_id").cast(pa.int64()).to_pylist()], [[n for _, n in found]], [ends.tolist()], [packed]])

    return written(map_batches(docs.select("doc_id", "text"), run, STREAM_DDL), "bucket-streams")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (bucket, count) as one."""
    values, counts = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first], np.add.reduceat(counts, first)


def encoded(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stream sorted and run-length encoded: its buckets in order, and how often each occurs."""
    ordered = np.sort(buckets).astype(np.int64)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], np.diff(first, append=len(ordered))


def counts(stream: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: at most a row for each bucket reaches the driver."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for packed in batch.column("buckets"):
                values, n = encoded(np.frombuffer(packed.as_buffer(), "<u2"))
                if len(values):
                    held.append((values, n))
                    size += len(values)
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield rows(schema, [x.tolist() for x in merged(held)])

    sums = map_batches(stream.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in sums.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(((t+1) (S+buckets)) / ((s+1) (T+buckets)))) of each bucket, with s and t its counts and S and T all of them."""
    all_s, all_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * all_s / ((corpus.get(b, 0) + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weighed(stream: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_words, ends, packed in zip(*(batch.column(c) for c in STREAM.names)):
                values = np.frombuffer(packed.as_buffer(), "<u2")
                ends = ends.values.to_numpy()
                sizes = np.diff(ends, prepend=0)
                weight, some = np.zeros(len(ends), np.int64), sizes > 0  # reduceat knows no empty stretches
                if some.any():
                    weight[some] = np.add.reduceat(gain[values], (ends - sizes)[some])
                yield rows(schema, [ids.values, n_words.values, pa.array(sizes), pa.array(weight)])

    return map_batches(stream, run, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """Adds score: the weight and 1000 times a standard Gumbel number that the id decides, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(table: DataFrame, n_drawn: int) -> DataFrame:
    """Adds rank: 1 and up to n_drawn for the rows of highest score, null for the others; ties go to smaller ids."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    dealt = table.repartitionByRange(partitions(table.sparkSession), *order).sortWithinPartitions(*order)
    # partition above, place in it below: written, as the bounds of ranges are drawn anew whenever the plan runs
    dealt = written(dealt.withColumn("place", F.monotonically_increasing_id()), "importance-order")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    totals = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("all"))  # a row for each range
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = dealt.withColumn("part", part).join(F.broadcast(totals.select("part", before.alias("base"))), "part")
    rank = F.col("base") + inside + 1
    return based.withColumn("rank", F.when(rank <= n_drawn, rank)).drop("part", "base", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null for documents that aren't drawn) of each row of docs. target: a table with text. Of the documents with
    least_words words or more, `percent` in a hundred are drawn."""
    if not 0 < buckets <= 1 << 16 or longest < 1:
        raise ValueError("buckets must be 1 to 65536 and longest 1 or more")
    corpus = streams(docs, longest, buckets)
    like = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    table = written(scored(weighed(corpus, gains(counts(corpus), counts(like), buckets)), seed), "importance-scores")
    eligible = table.where(F.col("n_words") >= least_words)
    drawn = ranked(eligible, eligible.count() * percent // 100)
    others = table.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
