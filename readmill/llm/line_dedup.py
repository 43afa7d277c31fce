r"""Line dedup: repeated runs of lines, found by a suffix array over line ids, built by distributed prefix doubling.

The lines of all documents, in order of doc_id and place, are a sequence of line ids; a suffix is compared up to the end of its
document. Level t of the array orders suffixes by their first 2^t lines: a suffix's rank is the number of suffixes with a
smaller prefix, and the rank at level t+1 comes from sorting the pairs (rank, rank of the suffix 2^t lines on) over ranges
of all pairs. A suffix whose rank nobody shares has found its place and takes no part in later levels, so after level 0 only repeated
lines go on; levels end when no rank is shared any more.

Suffixes with one rank at level t are an interval of the array whose longest common prefix is 2^t lines or more. In each
interval the first suffix, in order of documents, is the source; every other starts a later copy of it. A line's copy is that
of the longest prefix, from the deepest level at which it isn't the first. Copies that follow each other, from lines of a source
that do so too, are one maximal repeated run, which ends with the lines under its last copy. Runs of `min_lines` lines and
`min_words` words or more go. As called here both are 1: every later copy of a line goes, however short. Lines without words
stay, and runs reach across them.

Null and empty texts have no lines with words. Rows that share a doc_id are one document, ordered by their texts' hash; equal
rows are one. A null doc_id comes first. Texts of any length are cut into lines by the JVM. An empty table gives an empty
one. Other columns, whatever their names, pass through `without_repeats` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.llm.common import forget, map_batches, partitions, written

MIN_LINES, MIN_WORDS = 1, 1
#: Pairs that a range is meant to hold: few pairs make few ranges, and few small files.
RANGE = 25_000
NO_ID = -(1 << 63)

PLACE = ["doc", "part", "line"]
_WORD = r"[^\x20\x09-\x0D]+"


def key_of() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("part")]


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with words: doc (id, null as the least), part (hash of the text), line (its number among these), at (its number
    among all), a and b (two hashes of it, its id), words."""
    numbered = F.transform(F.split("text", "\n"), lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    worded = F.filter(numbered, lambda x: x["value"].rlike(_WORD))
    each = docs.where("text is not null").select(*key_of(), "text").select("doc", "part", F.posexplode(worded).alias("line", "x"))
    value = F.col("x.value")
    out = each.select(*PLACE, F.col("x.at").alias("at"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"), F.regexp_count(value, F.lit(_WORD)).alias("words"))
    return out.dropDuplicates(PLACE)


def ranked(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Adds rank to different (a, b, n): the number of suffixes, n for each pair, before the pair in the order of all pairs."""
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = min(partitions(pairs.sparkSession), -(-n_pairs // RANGE))
    if ranges < 2:  # one task holds them all
        return pairs.withColumn("rank", ahead(Window.orderBy("a", "b")))
    dealt = written(pairs.repartitionByRange(ranges, "a", "b").withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.sum("n").alias("all"))  # a row for each partition
    before = F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ahead(Window.partitionBy("range").orderBy("a", "b"))
    return dealt.withColumn("inside", inside).join(totals.select("range", before.alias("base")), "range").select("a", "b", "n", (F.col("base") + F.col("inside")).alias("rank"))


def repeats(lines: DataFrame, most_levels: int = 40) -> list[DataFrame]:
    """For each level t a table of doc, part, line, rank, source, first: the suffixes that share their first 2^t lines with others,
    the first of those, and whether it is this one."""
    levels: list[DataFrame] = []
    pairs = lines.select(*PLACE, "a", "b")
    for t in range(most_levels):
        shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("earliest")).where("n > 1")
        shared = written(shared, "shared")
        n_pairs = shared.count()
        if not n_pairs:
            forget(shared)
            break
        known = shared.select("a", "b", "earliest").join(ranked(shared.select("a", "b", "n"), n_pairs).select("a", "b", "rank"), ["a", "b"])
        level = pairs.join(known, ["a", "b"]).select(*PLACE, "rank", F.col("earliest").alias("source"), (F.struct(*PLACE) == F.col("earliest")).alias("first"))
        levels.append(written(level, f"level-{t}"))
        forget(shared)
        # a suffix whose next 2^t lines are no repeat, or are none, has found its place
        ahead = levels[-1].select("doc", "part", (F.col("line") - (1 << t)).alias("line"), F.col("rank").alias("b"))
        pairs = levels[-1].join(ahead, PLACE).select(*PLACE, F.col("rank").alias("a"), "b")
    return levels


def runs(levels: list[DataFrame]) -> DataFrame:
    """doc, part, start, lines, source (place): the maximal repeated runs of lines, without the first occurrence of each."""
    copies = reduce(DataFrame.unionByName, [level.where("not first").select(*PLACE, F.lit(t).alias("level"), "source") for t, level in enumerate(levels)])
    deepest = copies.groupBy(*PLACE).agg(F.max_by("source", "level").alias("source"), F.max("level").alias("level"))
    of = ["doc", "part", F.col("source.doc"), F.col("source.part"), F.col("line") - F.col("source.line")]
    before = F.lag("line").over(Window.partitionBy(*of).orderBy("line"))
    marked = deepest.withColumn("new", (F.coalesce(before, F.lit(-2)) != F.col("line") - 1).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(Window.partitionBy(*of).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["doc", "part", F.col("source.doc").alias("source_doc"), F.col("source.part").alias("source_part"), (F.col("line") - F.col("source.line")).alias("shift"), "run"]
    end = F.max(F.col("line") + F.expr("shiftleft(1, level)"))
    out = numbered.groupBy(*keys).agg(F.min("line").alias("start"), (end - F.min("line")).alias("lines"))
    return out.select("doc", "part", "start", "lines", F.struct(F.col("source_doc").alias("doc"), F.col("source_part").alias("part"), (F.col("start") - F.col("shift")).alias("line")).alias("source"))


def repeated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """doc, part, line, at of the lines that lie in later copies; the runs that they make up; and the levels of the suffix array."""
    lines = written(lines_of(docs), "lines")
    levels = repeats(lines)
    if not levels:
        none = lines.where(F.lit(False))
        return none.select(*PLACE, "at"), none.select("doc", "part", F.col("line").alias("start"), F.col("line").alias("lines")), levels
    found = runs(levels).where(F.col("lines") >= min_lines)
    under = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("line")
    if min_words > 1:
        found = found.withColumn("number", F.monotonically_increasing_id())
        long = found.select("number", "doc", "part", under).join(lines, PLACE).groupBy("number").agg(F.sum("words").alias("words")).where(F.col("words") >= min_words)
        found = found.join(long, "number", "left_semi").drop("number")
    found = written(found, "runs")
    gone = found.select("doc", "part", under).distinct()
    return gone.join(lines.select(*PLACE, "at"), PLACE), found, levels


def rebuilt(docs: DataFrame, gone: DataFrame, prefix: str) -> DataFrame:
    """docs with the text that is left; <prefix>lines and <prefix>gone (numbers of lines with words, before and removed)."""
    marks = gone.groupBy("doc", "part").agg(F.collect_list("at").alias("at"))
    marks = marks.select(*(F.col(c).alias(prefix + c) for c in ("doc", "part", "at")))
    doc, part = key_of()
    keyed = docs.select("*", doc.alias(prefix + "d"), part.alias(prefix + "p"))
    joined = keyed.join(marks, (F.col(prefix + "d") == F.col(prefix + "doc")) & (F.col(prefix + "p") == F.col(prefix + "part")), "left").drop(prefix + "d", prefix + "p", prefix + "doc", prefix + "part")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column(prefix + "at").to_pylist()):
                lines = text.split("\n") if text is not None else []
                n.append(sum(1 for x in lines if x.encode().strip()))
                gone = set(at or ())
                removed.append(len(gone))
                texts.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.int64()) for x in (n, removed)], names=[*names, *(prefix + c for c in ("lines", "gone"))])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{prefix}{c}` long" for c in ("lines", "gone")]
    return map_batches(joined, run, ", ".join(fields))


def free_prefix(columns: list[str]) -> str:
    prefix = "_l_"
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated lines; documents that lose every line with words go as a whole."""
    prefix = free_prefix(docs.columns)
    gone, _, _ = repeated(docs.select("doc_id", "text"), min_lines, min_words)
    left = rebuilt(docs, gone, prefix)
    return left.where((F.col(prefix + "gone") == 0) | (F.col(prefix + "gone") < F.col(prefix + "lines"))).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, n_runs and longest_run (of the maximal repeated runs that are later copies, in lines), deepest (2^t at the
    deepest level where the document has a later copy), kept_sha256 (of the text left) of each document."""
    docs = docs.select("doc_id", "text")
    gone, found, levels = repeated(docs, min_lines, min_words)
    facts = found.select("doc", "part", F.lit(1).cast("long").alias("n_runs"), F.col("lines").cast("long").alias("longest_run"), F.lit(0).cast("long").alias("deepest"))
    for t, level in enumerate(levels):
        none = F.lit(0).cast("long")
        facts = facts.unionByName(level.where("not first").select("doc", "part", none.alias("n_runs"), none.alias("longest_run"), F.lit(1 << t).cast("long").alias("deepest")))
    facts = facts.groupBy("doc", F.col("part").alias("p")).agg(F.sum("n_runs").alias("n_runs"), F.max("longest_run").alias("longest_run"), F.max("deepest").alias("deepest"))
    left = rebuilt(docs.select("doc_id", "text", key_of()[1]), gone, "_l_")
    left = left.select("doc_id", "part", F.col("_l_lines").alias("n_lines"), F.col("_l_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    out = left.join(facts, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (F.col("part") == F.col("p")), "left")
    return out.select("doc_id", "n_lines", "n_removed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_runs", "longest_run", "deepest")), "kept_sha256")
