"""Hard negatives: for anchors and their nearest rows of the same label, the nearest rows of other labels that are hardly farther away; scores are integer inner products.

All rows are rotated into the principal components of their second moments (summed over the whole table), which leaves inner products as they are and puts most
of them into the leading components. A block of rows meets a block of anchors: the leading part of the products is one matrix product; what is left of each is at most
the product of the two remainders' norms (Cauchy and Schwarz), and rounding is bounded by SLACK times the product of the norms. Pairs that can no longer enter a
list are discarded, the next components are added for the rest, and the survivors are settled by integer products of the vectors themselves. So
rotation and floating point decide only what is looked at, never a result.

Rows lie packed in blocks in the shared folder, anchors too. Each block of rows has one salt of a number that follows the tasks, or the blocks once these are many, and each
block of anchors is sent to all salts by a shuffle (copies of anchors would outgrow a broadcast): the query set meets all rows in tiles, none of which grows with the input. A
tile hands on the best few of each anchor, and those are merged by the anchor. First come the positives; they are put beside their anchors, and the second pass looks for negatives below each. The driver sees the moments (a row of D * D
numbers).

Rows with a null label, vector, component or id, or a component that isn't finite, take no part. Shorter vectors count as ending in zeros, and components beyond
MOST in size as MOST, so that scores fit 64 bits. Rows that share an id are rows of their own, but never each other's positives or negatives as the anchor's own id.
Ties go to smaller ids. An anchor without positives, or a positive without negatives in its range, gives no row; an empty table gives none. Vectors of more than
DENSE components are not rotated, which changes only the speed. Further columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.llm.common import rows, written

MOST, DENSE = 1 << 24, 1024
#: Rows and anchors of a block, and the bytes that it is meant to stay below.
ROWS, ANCHORS, BYTES = 4096, 1024, 4 << 20
#: Rows of a block that are looked at before the lists' least scores are drawn up again.
STEP = 512
#: Pairs whose products are worked out together.
PAIRS = 1 << 15
#: Blocks of rows that share a salt at most, on average: a task keeps them beside it while it goes through the anchors.
SALTED = 32
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("rotated", pa.binary())])
BLOCK_DDL = "block long, ids binary, labels binary, vectors binary, rotated binary"


def usable(table: DataFrame, vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, vec (floor of `scale` times each component) of the rows that take part."""
    x = F.col(vector)
    label = F.col(label) if isinstance(label, str) else label
    fine = F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return table.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vec"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of int32 as rows of a matrix, short ones filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def moments(table: DataFrame, width: int) -> np.ndarray:
    """The sum of all vectors' outer products with themselves, added up in two levels."""
    ddl, schema = "k int, sum binary", pa.schema([("k", pa.int32()), ("sum", pa.binary())])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("vec").slice(a, ROWS), width).astype(np.float64)
                total += x.T @ x
        from pyspark import TaskContext

        yield rows(schema, [[TaskContext.get().partitionId() % 64], [total.tobytes()]])

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = np.zeros(width * width), None
        for batch in batches:
            for k, x in zip(batch.column("k").to_pylist(), batch.column("sum")):
                total += np.frombuffer(x.as_buffer())
        if k is not None:
            yield rows(schema, [[0], [total.tobytes()]])

    parts = table.select("vec").mapInArrow(of_rows, ddl).repartition(64, "k").mapInArrow(of_sums, ddl)
    sums = parts.repartition(1).mapInArrow(of_sums, ddl).collect()  # one row
    return np.frombuffer(sums[0]["sum"]).reshape(width, width) if sums else np.zeros((width, width))


def rotation(table: DataFrame, width: int) -> np.ndarray | None:
    """[component, principal component], those with the largest moments first."""
    return np.ascontiguousarray(np.linalg.eigh(moments(table, width))[1][:, ::-1]) if 0 < width <= DENSE else None


def packed(table: DataFrame, width: int, turn: np.ndarray | None, most: int) -> DataFrame:
    """The rows in blocks of at most `most` rows or about BYTES."""
    most = max(16, min(most, BYTES // (8 * max(1, width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def block(some: pa.Table) -> pa.RecordBatch:
            x = matrix(some.column("vec").combine_chunks(), width)
            y = (x @ turn if turn is not None else x).astype(np.float32)
            ids, labels = (some.column(c).to_numpy() for c in ("vec_id", "label"))
            return rows(BLOCK, [[number], *([v.tobytes()] for v in (ids, labels, x, y))])

        for batch in batches:
            held += [batch.slice(a, most) for a in range(0, batch.num_rows, most)]
            while sum(b.num_rows for b in held) >= most:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, most))
                number += 1
                held = whole.slice(most).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return written(table.mapInArrow(run, BLOCK_DDL), "vector-blocks")


class Vectors:
    """A block, with the norms of its vectors and of what is left of them from each stage on."""

    def __init__(self, record: dict, width: int, cuts: tuple[int, ...]):
        self.ids, self.labels = np.frombuffer(record["ids"], np.int64), np.frombuffer(record["labels"], np.int64)
        self.exact = np.frombuffer(record["vectors"], np.int32).reshape(len(self.ids), width)
        self.turned = np.frombuffer(record["rotated"], np.float32).reshape(len(self.ids), width)
        squares = np.cumsum(self.turned.astype(np.float64)[:, ::-1] ** 2, axis=1)[:, ::-1] if width else np.zeros((len(self.ids), 1))
        self.norm = np.sqrt(squares[:, 0])
        self.rest = [np.sqrt(squares[:, c]) if c < width else np.zeros(len(self.ids)) for c in cuts]


@dataclass
class Lists:
    """The best few (score, id) of each of a number of lists."""

    n: int
    most: int

    def __post_init__(self):
        self.key = self.score = self.id = np.empty(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, key))
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
        stay = order[place < self.most]
        self.key, self.score, self.id = key[place < self.most], score[stay], ident[stay]

    def least(self, otherwise: np.ndarray) -> np.ndarray:
        """The score that a list's last place has; where there is room, what is given."""
        out = otherwise.astype(np.float64)
        if len(self.key):
            last = np.flatnonzero(np.diff(self.key, append=self.n))
            full = last[np.bincount(self.key, minlength=self.n)[self.key[last]] == self.most]
            out[self.key[full]] = np.maximum(out[self.key[full]], self.score[full])
        return out


def pairs(block: Vectors, anchors: Vectors, cuts: tuple[int, ...], some: slice, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, anchors and exact scores of all pairs that are allowed and whose score can lie in one of the anchor's ranges. allowed: [row, anchor];
    low, high: [range, anchor]."""
    width = block.turned.shape[1]
    slack = (width + 16) * 2.0**-22

    def near(product: np.ndarray, reach: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        top, bottom = product + reach, product - reach
        found = np.zeros(product.shape, bool)
        for k in range(len(low)):
            found |= (top >= low[k][at]) & (bottom <= high[k][at])
        return found

    norms = block.norm[some]
    product = (block.turned[some, : cuts[0]] @ anchors.turned[:, : cuts[0]].T).astype(np.float64)
    reach = np.multiply.outer(block.rest[0][some], anchors.rest[0]) + slack * np.multiply.outer(norms, anchors.norm) + 1
    i, j = np.nonzero(allowed & near(product, reach, slice(None)))
    product = product[i, j]
    i += some.start
    for a in range(0, len(i), PAIRS):
        r, c, part = i[a : a + PAIRS], j[a : a + PAIRS], product[a : a + PAIRS]
        for stage in range(1, len(cuts)):
            b, e = cuts[stage - 1], cuts[stage]
            part = part + np.einsum("ij,ij->i", block.turned[r, b:e], anchors.turned[c, b:e])
            stay = near(part, block.rest[stage][r] * anchors.rest[stage][c] + slack * block.norm[r] * anchors.norm[c] + 1, c)
            r, c, part = r[stay], c[stay], part[stay]
        yield r, c, np.einsum("ij,ij->i", block.exact[r].astype(np.int64), anchors.exact[c].astype(np.int64))


def stages(width: int) -> tuple[int, ...]:
    """How many leading components each stage has seen."""
    return tuple(sorted({min(width, max(1, -(-width * k // 4))) for k in (1, 2, 3)})) if width else (0,)


def salts_for(n_blocks: int, tasks: int) -> int:
    """Salts for this many blocks of rows: two for each task that runs at once, as far as there are blocks, and more only where blocks are many."""
    return max(1, min(n_blocks, 2 * tasks), -(-n_blocks // SALTED))


def met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """All blocks of rows beside each block of anchors. Both sides are shuffled by the salt: with all their copies anchors outgrow the sizes that the optimizer knows."""
    salts = salts_for(blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism)
    left = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    # salts fall on tasks by their hashes: of four times as many tasks few get two
    left, right = (side.repartition(4 * salts, "salt").hint("merge") for side in (left, right))
    return left.join(right, "salt").drop("salt")


def tiles(blocks: DataFrame, anchors: DataFrame, find: Callable[[dict | None, dict], list | None], ddl: str, schema: pa.Schema) -> DataFrame:
    """All blocks of rows with all blocks of anchors (whose columns have names that begin with a_). find(block, state) keeps what it finds in the state of a block of
    anchors, which holds that block as `anchor`; find(None, state) gives it as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda names: {c.removeprefix("a_"): batch.column(c)[k].as_py() for c in names}  # noqa: B023, E731
                number = batch.column("a_block")[k].as_py()
                if number not in held:
                    if len(held) == 4:
                        for state in held.values():
                            yield rows(schema, find(None, state))
                        held.clear()
                    held[number] = {"block": number, "anchor": of([c for c in batch.schema.names if c.startswith("a_")])}
                find(of(BLOCK.names), held[number])
        for state in held.values():
            yield rows(schema, find(None, state))
        pa.default_memory_pool().release_unused()

    return met(blocks, anchors).mapInArrow(run, ddl)


def best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key, with rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. table: vec_id, label, vec (see usable). Anchors are the rows whose id is divisible by `every`;
    a negative's score is at most its positive's and at least `percent` hundredths of it."""
    table = written(table, "vectors")
    width = table.agg(F.max(F.size("vec"))).first()[0] or 0
    turn, cuts = rotation(table, width), stages(width)
    queries = table.where(F.col("vec_id") % every == 0)
    blocks = packed(table, width, turn, ROWS)
    n_anchors = queries.count()
    anchors = packed(queries.repartition(max(1, -(-n_anchors // ANCHORS))), width, turn, ANCHORS)
    anchors = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    fields = [("a_block", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]

    def of_same_label(record: dict | None, state: dict) -> list | None:
        if record is None:
            lists = state["lists"]
            return [[state["block"]] * len(lists.key), lists.key.astype(np.int32), lists.score, lists.id]
        if "anchors" not in state:
            state["anchors"] = Vectors(state["anchor"], width, cuts)
            state["lists"] = Lists(len(state["anchors"].ids), positives)
        block, own, lists = Vectors(record, width, cuts), state["anchors"], state["lists"]
        top = np.full((1, lists.n), np.inf)
        for a in range(0, len(block.ids), STEP):
            some = slice(a, min(a + STEP, len(block.ids)))
            allowed = (block.labels[some, None] == own.labels) & (block.ids[some, None] != own.ids)
            for r, c, score in pairs(block, own, cuts, some, allowed, lists.least(np.full(lists.n, -np.inf))[None], top):
                lists.add(c, score, block.ids[r])

    found = tiles(blocks, anchors, of_same_label, "a_block long, place int, score long, id long", pa.schema(fields))
    near = written(best(found, ["a_block", "place"], positives), "positives")
    # beside the anchors: of each block the places and scores of its positives
    beside = near.groupBy("a_block").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "score"))).alias("a_positives"))
    asked = anchors.join(beside, "a_block")

    def of_other_labels(record: dict | None, state: dict) -> list | None:
        if record is None:
            lists = state["lists"]
            return [[state["block"]] * len(lists.key), (lists.key // positives).astype(np.int32), lists.score, lists.id, (lists.key % positives + 1).astype(np.int32)]
        if "anchors" not in state:
            own = state["anchors"] = Vectors(state["anchor"], width, cuts)
            state["lists"] = Lists(len(own.ids) * positives, negatives)
            state["top"] = np.full((len(own.ids), positives), np.iinfo(np.int64).min)
            for p in state["anchor"]["positives"]:
                state["top"][p["place"], p["rank"] - 1] = p["score"]
            state["some"] = state["top"] != np.iinfo(np.int64).min
            # the least score s with percent * p <= 100 * s, without large products
            state["bottom"] = percent * (state["top"] // 100) + -((-percent * (state["top"] % 100)) // 100)
        block, own, lists, there = Vectors(record, width, cuts), state["anchors"], state["lists"], state["some"]
        high, lowest = np.where(there, state["top"], -np.inf), np.where(there, state["bottom"], np.inf)
        for a in range(0, len(block.ids), STEP):
            some = slice(a, min(a + STEP, len(block.ids)))
            allowed = (block.labels[some, None] != own.labels) & (block.ids[some, None] != own.ids)
            low = lists.least(lowest.reshape(-1)).reshape(lowest.shape)
            for r, c, score in pairs(block, own, cuts, some, allowed, low.T, high.T):
                for k in range(positives):
                    at = np.flatnonzero(there[c, k] & (score <= state["top"][c, k]) & (score >= state["bottom"][c, k]))
                    if len(at):
                        lists.add(c[at] * positives + k, score[at], block.ids[r[at]])

    ddl, schema = "a_block long, place int, score long, id long, positive int", pa.schema([*fields, ("positive", pa.int32())])
    hard = best(tiles(blocks, asked, of_other_labels, ddl, schema), ["a_block", "place", "positive"], negatives)
    hard = hard.select("a_block", "place", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchor_ids(anchors)
    named = near.select("a_block", "place", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["a_block", "place"])
    return hard.join(named, ["a_block", "place", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchor_ids(anchors: DataFrame) -> DataFrame:
    """a_block, place, anchor_id."""
    schema = pa.schema([("a_block", pa.int64()), ("place", pa.int32()), ("anchor_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("a_block").to_pylist(), batch.column("a_ids")):
                found = np.frombuffer(ids.as_buffer(), np.int64)
                yield rows(schema, [[block] * len(found), list(range(len(found))), found])

    return anchors.select("a_block", "a_ids").mapInArrow(run, "a_block long, place int, anchor_id long")
