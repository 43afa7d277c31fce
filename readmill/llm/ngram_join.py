"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets.

1. Each text gives its set of n-grams of words, a digest of that set, and the keys of its bands of MinHash values. The number
   of bands is the least that reaches the target recall at the threshold.
2. Texts with one set are one class; its least doc_id stands for it. Only these representatives go on.
3. Representatives that share a band key meet in that key's bucket, in blocks where it is large. There their whole signatures (a
   byte of each MinHash value) are compared, and those that agree as often as similar texts do are joined by a spanning
   forest: no pairs are emitted, and texts that share a band by chance stay apart. The forests' components are found.
4. Each component's sets meet in one group, or, where it is large, in blocks: each pair of blocks is a group of bounded
   size. There all pairs are counted on their full sets, a frequent n-gram as a row of a matrix product, a rare one by its
   few owners. Pairs are counted, not emitted: out come each representative's number of links, and a spanning forest.
5. The forests' components are the classes of near duplicates.

Texts of fewer than n words have their whole word sequence for their only n-gram; texts without words (null, empty) have
none and no links. Every row is a document of its own, known by its id and its text's hash: rows that share an id, or have none, are linked by their texts alone.
A null doc_id is returned as null and comes after all others in its class. An empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import map_batches, partitions, utf8, window_hashes, word_hashes, written
from readmill.llm.components import components

N, SIMILARITY, RECALL = 5, 0.8, 0.99999
#: N-grams (of all members) and sets that a block of a component is meant to hold, and sets in a block of a bucket.
BLOCK, BLOCK_SETS, BUCKET = 400_000, 2000, 2000
_SALT = np.random.default_rng(7).integers(1, 1 << 32, size=1024, dtype=np.uint32) | np.uint32(1)


def bands_for(similarity: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """Bands and rows of a band: 1 - (1 - s^rows)^bands reaches the recall at similarity s."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def grams(text: bytes, n: int) -> np.ndarray:
    """The different n-grams of a text, as sorted 64-bit hashes."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(n, len(h))) ^ np.uint64(0 if len(h) >= n else len(h)))


def signature(g: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The least values of the hash functions over the n-grams, a row for each band."""
    x = (g >> np.uint64(32)).astype(np.uint32) ^ g.astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        y = x[a : a + 4096, None] * _SALT[: bands * rows]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, (y ^ (y >> np.uint32(13))).min(0), out=least)
    return least.reshape(bands, rows)


def band_keys(values: np.ndarray) -> list[int]:
    """A key for each band."""
    return [int(window_hashes(v.astype(np.uint64) + np.uint64(k << 32), len(v))[0].astype(np.int64)) for k, v in enumerate(values)]


def enough(similarity: float, values: int) -> int:
    """How many bytes of two signatures agree at least at the similarity, but for one pair in some millions (five deviations)."""
    return math.floor(values * similarity - 5 * math.sqrt(values * similarity * (1 - similarity)))


def forest(signatures: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the signatures (rows) of which at least so many bytes agree. A row is only compared with
    rows that nothing ties to it yet, so a bucket of near copies takes about one pass."""
    n = len(signatures)
    label, edges = np.arange(n), []
    for i in range(n - 1):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        for a in range(0, len(other), 4096):
            some = other[a : a + 4096]
            near = some[(signatures[some] == signatures[i]).sum(1) >= least]
            for j in near.tolist():
                if label[j] != label[i]:
                    edges.append((i, j))
                    label[label == label[j]] = label[i]
    return edges


def links_in(sets: list[np.ndarray], others: list[np.ndarray] | None, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Numbers of linked documents of each set (and of each of the others), and edges of a spanning forest over both.

    With `others` only pairs of a set and one of the others count, without it pairs inside `sets`."""
    both = sets + (others or [])
    na, n = len(sets), len(both)
    first = na if others is not None else 0
    owner = np.repeat(np.arange(n), [len(s) for s in both])
    flat = np.concatenate(both)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.r_[start, len(flat)])
    sizes = np.array([len(s) for s in both])
    common = np.zeros((na, n - first), np.float32)
    # n-grams of many owners: slices of a matrix of owners and n-grams, multiplied with itself
    many = np.flatnonzero(size > 24)
    for a in range(0, len(many), 2048):
        some = many[a : a + 2048]
        held = np.zeros((n, len(some)), np.float32)
        for k, g in enumerate(some.tolist()):
            held[owner[start[g] : start[g] + size[g]], k] = 1
        common += held[:na] @ held[first:].T
    # n-grams of few owners: their pairs, in ascending order of owners
    for k in np.unique(size[(size <= 24) & (size > 1)]):
        at = start[size == k]
        for a in range(0, len(at), 100_000):
            members = owner[at[a : a + 100_000, None] + np.arange(k)]
            for i in range(k - 1):
                x, y = np.repeat(members[:, i], k - 1 - i), members[:, i + 1 :].ravel()
                ok = (x < na) & (y >= first)
                np.add.at(common, (x[ok], y[ok] - first), 1)
    linked = np.zeros(n, np.int64)
    edges: list[tuple[int, int]] = []
    label = np.arange(n)
    step = 256
    for a in range(0, na, step):
        b = min(a + step, na)
        part = common[a:b]
        near = part >= similarity * (sizes[a:b, None] + sizes[None, first:] - part) - 1e-6
        near &= part > 0
        if others is None:
            near &= np.arange(a, b)[:, None] < np.arange(first, n)[None, :]
        linked[a:b] += near @ weight[first:]
        linked[first:] += weight[a:b] @ near
        for i in range(a, b):
            to = first + np.flatnonzero(near[i - a])
            for j in to[label[to] != label[i]].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    edges.append((i, j))
    return linked[:na], linked[na:], edges


def in_blocks(members: DataFrame, by: list[str], cuts: str, *columns: str) -> DataFrame:
    """The members of each group in blocks, `cuts` for a group, each pair of blocks (i <= j) a group of its own; `right` where a
    member stands for the second block. Sorted by group within partitions."""
    block = F.pmod(F.xxhash64("set_id"), F.col(cuts))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(cuts) - 1))
    dealt = members.select(*by, block.alias("block"), "set_id", *columns, other.alias("other"))
    dealt = dealt.select(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"), "set_id", *columns)
    return dealt.repartition(partitions(members.sparkSession), *by, "i", "j").sortWithinPartitions(*by, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """The columns of each group of rows that follow each other with equal keys."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(*(columns[c] for c in by)))
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != now:
                if held:
                    yield held
                held, now = {c: [] for c in columns}, keys[a]
            for c, values in columns.items():
                held[c] += values[a:b]
            a = b
    if held:
        yield held


def classified(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """near_duplicates with two columns more: hash (of the text), and whether the row is its class's first."""
    bands, rows = bands_for(similarity, recall)
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")

    def signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [grams(t, n) for t in utf8(batch, "text")]
            sums = [(int(np.bitwise_xor.reduce(g).astype(np.int64)), int(g.sum(dtype=np.uint64).astype(np.int64))) if len(g) else (0, 0) for g in found]
            values = [signature(g, bands, rows) if len(g) else None for g in found]
            keys = pa.array([[] if v is None else band_keys(v) for v in values], pa.list_(pa.int64()))
            short = pa.array([b"" if v is None else v.astype(np.uint8).tobytes() for v in values], pa.binary())
            numbers = [pa.array(x, pa.int64()) for x in ([len(g) for g in found], [s[0] for s in sums], [s[1] for s in sums])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("hash"), *numbers, keys, short], names=["doc_id", "hash", "n_grams", "x", "y", "keys", "signature"])

    signs = written(map_batches(docs, signed, "doc_id long, hash long, n_grams long, x long, y long, keys array<long>, signature binary"), "signatures")
    some = signs.where("n_grams > 0")
    # a set's first row: the least id, null after all others, then the least hash
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")
    sets = some.groupBy("n_grams", "x", "y").agg(F.min(first).alias("first"), F.count("*").alias("n_docs"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    sets = written(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    keyed = sets.select("set_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / BUCKET)).select("key", "cuts")
    met = keyed.join(shared, "key").join(sets.select("set_id", "signature"), "set_id")
    least = enough(similarity, bands * rows)

    def tie(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in groups(it, ["key", "i", "j"]):
            ids = list(dict(zip(members["set_id"], members["signature"])).items())
            found = forest(np.frombuffer(b"".join(x for _, x in ids), np.uint8).reshape(len(ids), -1), least) if len(ids) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[e[k]][0] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    nominated = components(map_batches(in_blocks(met, ["key"], "cuts", "signature"), tie, "a long, b long"))
    # the sets of each component, in blocks
    known = sets.select("set_id", "n_docs", "n_grams").join(nominated.withColumnRenamed("node", "set_id"), "set_id")
    held = known.groupBy("component").agg(F.greatest(F.ceil(F.sum("n_grams") / BLOCK), F.ceil(F.count("*") / BLOCK_SETS)).alias("cuts"))
    known = written(known.join(held, "component").select("set_id", "n_docs", "component", "cuts"), "blocks")
    where = known.join(sets.select("set_id", F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("of_text")), "set_id")
    texts = docs.join(where, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("of_text"))).select("text", "set_id", "n_docs", "component", "cuts")

    def as_grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = pa.array([grams(t, n).astype("<u8").tobytes() for t in utf8(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([found] + [batch.column(c) for c in ("set_id", "n_docs", "component", "cuts")], names=["grams", "set_id", "n_docs", "component", "cuts"])

    shaped = map_batches(texts, as_grams, "grams binary, set_id long, n_docs long, component long, cuts long")
    dealt = in_blocks(shaped, ["component"], "cuts", "n_docs", "grams")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(it, ["component", "i", "j"]):
            unique: dict = {}
            for set_id, weight, g, right in zip(held["set_id"], held["n_docs"], held["grams"], held["right"]):
                unique.setdefault((set_id, right), (weight, np.frombuffer(g, "<u8")))  # a row that is there several times comes several times
            left = [(s, *v) for (s, r), v in unique.items() if not r]
            other_side = [(s, *v) for (s, r), v in unique.items() if r]
            both, cross = left + other_side, held["i"][0] != held["j"][0]
            if len(both) < 2 or cross and not (left and other_side):
                continue
            weight = np.array([w for _, w, _ in both], np.int64)
            a, b, edges = links_in([g for _, _, g in left], [g for _, _, g in other_side] if cross else None, weight, similarity)
            out = [(s[0], int(k), None) for s, k in zip(both, np.r_[a, b]) if k] + [(both[x][0], 0, both[y][0]) for x, y in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["set_id", "links", "to"])

    verified = written(map_batches(dealt, verify, "set_id long, links long, to long"), "verified")
    classes = components(verified.where("to is not null").select(F.col("set_id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "set_id")
    tied = written(sets.select("set_id", "first").join(classes, "set_id"), "classes")
    leader = tied.groupBy("component").agg(F.min("first").alias("leader"))
    links = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    facts = sets.select("n_grams", "x", "y", "set_id", "n_docs", "first").join(links, "set_id", "left").join(tied.select("set_id", "component").join(leader, "component").select("set_id", "leader"), "set_id", "left")
    facts = facts.select("n_grams", "x", "y", "first", F.coalesce("leader", "first").alias("leader"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    own = some.select("doc_id", "hash", "n_grams", "x", "y").join(facts, ["n_grams", "x", "y"])
    leads = F.col("leader.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("leader.hash") == F.col("hash"))
    own = own.select("doc_id", F.col("leader.doc_id").alias("class_id"), "n_links", F.col("first.doc_id").alias("set_id"), "n_grams", "hash", leads.alias("leads"))
    none = signs.where("n_grams = 0")  # texts without words: each a class of its own
    return own.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"), "n_grams", "hash", F.lit(True).alias("leads")))


def near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its component of near duplicates; null if all are), n_links (other documents at the similarity or
    above, copies included), set_id (least doc_id with the same n-grams), n_grams of each document."""
    return classified(docs, n, similarity, recall).drop("hash", "leads")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without near duplicates: of each class, its least doc_id stays (of rows with that id or without one, the least hash of the text), and of rows equal in id
    and text one."""
    name = "_kept"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    kept = classified(docs, **how).where("leads").groupBy(F.col("doc_id").alias(name), F.col("hash").alias(name + "h")).agg(F.count("*").alias(name + "n"))
    kept = written(kept, "kept")
    hashed = docs.withColumn(name + "t", F.xxhash64(F.coalesce("text", F.lit(""))))
    of = lambda rows: hashed.join(kept.where(rows), F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(name + "t") == F.col(name + "h")), "left_semi").drop(name + "t")
    several = f"{name}n > 1"
    return of(f"{name}n = 1").unionByName(of(several).dropDuplicates(["doc_id", "text"])) if not kept.where(several).isEmpty() else of("true")
