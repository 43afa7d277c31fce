"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Slot n of the schedule is the golden-ratio point frac(n * 0.618...). Cumulative target shares map it to a source, and its
rank among that source's slots names the block to take there: documents of a source, in the order of a hash of their id,
form one stream, repeated, that is cut into blocks of equal numbers of words. So each source's share is right to within a
few blocks over any stretch of the schedule, and a document is repeated only when its source has been used up. For a source
with a target of fewer than FEW blocks that is too coarse: its blocks are as many as its target needs, placed evenly over the
schedule, and the last one ends at the target.

Running totals go by two levels (within ranges of the hash, then over the ranges), so a source with a third of all rows
isn't sorted in one task; slots find their source by a join on cells of the unit interval. Only totals go to the driver.

A null source is a source of its own, last in order. Null and empty texts have size 0 and are taken 0 times. Rows with one
doc_id are documents of their own. An empty table, or one without words, takes nothing. `mix` drops extra columns, `mixed` keeps them whatever their names.
Rows of one id follow each other by size and a hash of the text, so that the order of a table's rows doesn't matter. The
targets of all sources are settled in one task, which is meant for up to some millions of sources.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.llm.common import WORD, written

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
#: n = high * SPLIT + low keeps the products below 2^53 precise enough for any number of slots.
SPLIT = 1 << 26
LOW, HIGH = float(_GOLDEN), float(_GOLDEN * SPLIT % 1)
MOST_WORDS = 4096
CHUNK = 1 << 16
FEW = 256


def row_of() -> Column:
    return F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def golden_point(n: Column) -> Column:
    x = F.floor(n / SPLIT) * F.lit(HIGH) + F.pmod(n, F.lit(SPLIT)) * F.lit(LOW)
    return x - F.floor(x)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, k (rank in order of code points, null last), source_size, target. Targets share `share` of all sizes by weight;
    none is above `most` times its source's size, and what is cut off goes to the others by weight."""
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("k", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    # filled in order of cap to weight, the sources that reach their cap come first
    filled = Window.orderBy("ratio", "k")
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * float(share) - before) / rest)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(all_rows)["level"])
    return s.select("source", "k", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def schedule(sources: DataFrame, total: float, words: int, cells: int = 4096) -> DataFrame:
    """k (source), rank: the slots, in the order of n, each with its rank among its source's."""
    spark = sources.sparkSession
    slots = spark.range(int(-(-total // words))).select(F.col("id").alias("n"), golden_point(F.col("id")).alias("u"))
    up_to = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = sources.select("k", "target", (F.sum("target").over(up_to) / total).alias("end"))
    ends = ends.select("k", F.coalesce(F.lag("end").over(Window.orderBy("k")), F.lit(0.0)).alias("begin"), F.when(F.lead("k").over(Window.orderBy("k")).isNull(), 2.0).otherwise(F.col("end")).alias("end"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = ends.where("end > begin").withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))))
    dealt = slots.withColumn("cell", cell(F.col("u"))).join(spans, "cell").where("u >= begin and u < end").select("n", "k", F.floor(F.col("n") / CHUNK).alias("chunk"))
    counts = dealt.groupBy("k", "chunk").count()
    counts = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("n")) - 1
    return dealt.withColumn("inside", inside).join(counts.drop("count"), ["k", "chunk"]).select("n", "k", (F.col("base") + F.col("inside")).alias("rank"))


def goal(words: int) -> Column:
    """Where the stream of a source of few blocks ends, at one word or more; null for other sources."""
    return F.when((F.col("target") > 0) & (F.col("target") < FEW * words), F.greatest(F.lit(1), F.round("target")).cast("long"))


def settled(slots: DataFrame, sources: DataFrame, total: float, words: int) -> DataFrame:
    """The slots, with those of sources of few blocks replaced by as many as the target needs, at even distances."""
    few = sources.select("k", F.ceil(goal(words) / words).alias("need")).where("need > 0")
    even = few.select("k", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("rank"))
    n = F.floor((F.col("rank") + golden_point(F.col("k") + 1)) * int(-(-total // words)) / F.col("need"))
    return slots.join(few, "k", "left_anti").select("n", "k", "rank").unionByName(even.select(n.alias("n"), "k", "rank"))


def streams(sizes: DataFrame, n_rows: int) -> DataFrame:
    """Adds start: the words before a document in its source's stream."""
    digits = 1
    while n_rows / 16**digits > 20_000 and digits < 8:
        digits += 1
    # rows without an id are told apart by their texts, so that no range holds them all
    s = sizes.withColumn("order", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))))
    s = s.withColumn("range", F.substring("order", 1, digits))
    totals = s.groupBy("k", "range").agg(F.sum("size").alias("in_range"))
    totals = totals.withColumn("base", F.coalesce(F.sum("in_range").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("k", "range").orderBy("order", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return s.join(totals.drop("in_range"), ["k", "range"]).withColumn("start", F.col("base") + F.col("inside")).drop("range", "order", "base", "inside")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, size: Column | None = None) -> DataFrame:
    """doc_id, source, row (hash of id and text), size, source_size, target, taken (words) of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    sizes = written(docs.select("doc_id", "source", row_of().alias("row"), size.alias("size")), "mix-sizes")
    sources = written(targets(sizes, weights, share, most), "mix-sources")
    all_of = sources.agg(F.sum("target").alias("total"), F.count("*").alias("n")).first()
    n_rows, total = sizes.count(), float(all_of["total"] or 0)
    words = int(max(1, min(MOST_WORDS, total // (2000 * max(1, all_of["n"])))))
    known = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = written(streams(known, n_rows), "mix-streams")
    slots = settled(schedule(sources, total, words), sources, total, words) if total > 0 else docs.sparkSession.createDataFrame([], "n long, k int, rank long")
    # a document's place in the first and the second run through its source's stream, and the blocks there
    run = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))).alias("run")
    copies = placed.where("size > 0").select("k", "start", "size", "source_size", goal(words).alias("goal"), run).withColumn("at", F.col("start") + F.col("run") * F.col("source_size"))
    blocks = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / words), F.floor((F.col("at") + F.col("size") - 1) / words))))
    end = F.least((F.col("rank") + 1) * words, F.floor(F.col("source_size") * float(most)), F.col("at") + F.col("size"), F.col("goal"))
    overlap = F.greatest(end - F.greatest(F.col("rank") * words, F.col("at")), F.lit(0))
    taken = blocks.join(slots, ["k", "rank"]).groupBy("k", "start").agg(F.sum(overlap).alias("words"))
    out = placed.join(taken.withColumnRenamed("k", "tk").withColumnRenamed("start", "ts"), (F.col("k") == F.col("tk")) & (F.col("start") == F.col("ts")), "left")
    got = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "row", "size", "source_size", "target", got.alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, to the nearest whole number: texts are not cut."""
    name = "_row"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    times, again = name + "_times", name + "_again"
    taken = mix(docs, **how).groupBy(F.col("row").alias(name)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = taken.where("size > 0").select(name, F.round(F.col("taken") / F.col("size")).cast("int").alias(times)).where(F.col(times) > 0)
    joined = docs.withColumn(name, row_of()).join(copies, name)
    return joined.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(again)).drop(again)
