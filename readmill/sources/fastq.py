"""FASTQ and FASTA files as a data source: `spark.read.format("reads").load(path)`; `readmill.streaming` reads them as they arrive.

Options: path (file, or several joined by commas), path2 (second reads of pairs), layout (single, paired, interleaved), kind (fastq,
fasta; else told by the first byte), split (bytes of a file for one part). Plain and gzip files of single reads are cut into
parts (`readmill.sources.parts`), and small parts of large inputs share tasks; .bz2 and .xz files, and pairs by this source, are one task a file. `read_pairs` reads pairs and
interleaved files in parts. Any file system that pyarrow can open works. Rows: read_idx (orders records as in the files), name,
sequence, qualities (null for FASTA); for pairs read_idx and two structs r1 and r2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readmill.sources.parts import BATCH, RECORDS_A_BYTE, Block, FormatError, Part, Record, blocks, fasta_records, fastq_blocks, fastq_records, located, open_any, open_at, open_plain
from readmill.sources.writers import scratch

SINGLE = "read_idx long, name string, sequence string, qualities string"
PAIRED = "read_idx long, r1 struct<name:string,sequence:string,qualities:string>, r2 struct<name:string,sequence:string,qualities:string>"
SPLIT = 64 << 20
#: Parts below SPLIT share a task so that tasks are no smaller than they need be for this many of them.
TASKS = 256
#: Records between two marks of an index, at most.
EVERY = 16_384
#: The number of a file stands above this many bits of the place in it.
PLACE_BITS = 46
READ = pa.struct([(c, pa.string()) for c in ("name", "sequence", "qualities")])


def kind_of(first: bytes) -> str:
    """fastq or fasta, by the first byte; an empty file counts as FASTQ."""
    if first[:1] in (b"", b"@"):
        return "fastq"
    if first[:1] in (b">", b"#"):
        return "fasta"
    raise FormatError(f"neither FASTQ nor FASTA: it starts with {first[:1]!r}")


def kind_in(path: str) -> str:
    with open_any(path) as stream:
        return kind_of(stream.read(1))


def records(path: str, kind: str | None = None) -> Iterator[Record]:
    kind = kind or kind_in(path)
    with open_any(path) as stream:
        yield from fastq_records(stream, path) if kind == "fastq" else fasta_records(stream, path)


class _Parts(InputPartition):
    """Parts that one task reads, one after the other."""

    def __init__(self, parts: list[_Part]):
        self.parts = parts


class _Part(InputPartition):
    def __init__(self, number: int, path: str, kind: str, start: int = 0, stop: int | None = None, path2: str | None = None):
        self.number, self.path, self.kind, self.start, self.stop, self.path2 = number, path, kind, start, stop, path2


def listed_files(listed: str) -> list[str]:
    """The files of a path, or of several joined by commas; a folder stands for its files in order of names."""
    from pyarrow import fs

    found = []
    for p in filter(None, (x.strip() for x in listed.split(","))):
        system, inner = located(p)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            head = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            found += sorted(head + x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file and not x.base_name.startswith(("_", ".")))
        else:
            found.append(p)
    if len(found) >= 1 << 63 - PLACE_BITS:
        raise ValueError(f"{len(found)} files in one table; read them as several")
    return found


def _ends(path: str, split: int) -> tuple[int, int | None]:
    """How many parts a file has, and where it ends; none where it can't be cut."""
    if path.endswith((".bz2", ".xz")):
        return 1, None
    with open_plain(path) as stream:
        size = stream.seek(0, 2)
    return -(-max(size, 1) // split), size


def _ranges(path: str, split: int) -> list[tuple[int, int | None]]:
    """The bounds of a file's parts; one without an end where it can't be cut."""
    parts, size = _ends(path, split)
    return [(0, None)] if size is None else [(k * split, min((k + 1) * split, size)) for k in range(parts)]


def tasks_for(size: int, parts: int) -> int:
    """Tasks for that many parts of that many bytes in all: one each while they are few, and else as many as parts of SPLIT would take."""
    return max(1, min(parts, max(TASKS, -(-size // SPLIT))))


def _tasks(files: list[tuple]) -> int:
    """Tasks for files of (number, path, parts, end, parts before)."""
    return tasks_for(sum(f[3] or 0 for f in files), sum(f[2] for f in files)) if all(f[3] is not None for f in files) else max(1, sum(f[2] for f in files))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.layout = self.options.get("layout", "paired" if self.options.get("path2") else "single")
        self.kind = self.options.get("kind")

    def partitions(self) -> list[_Parts]:
        paths, others, split = listed_files(self.options.get("path", "")), listed_files(self.options.get("path2", "")), int(self.options.get("split", SPLIT))
        if self.layout == "paired" and len(paths) != len(others):
            raise FormatError("pairs need as many second files as first ones")
        parts = []
        for number, path in enumerate(paths):
            kind = self.kind or kind_in(path)
            if self.layout == "single":
                parts += [_Part(number, path, kind, *r) for r in _ranges(path, split)]
            else:
                parts.append(_Part(number, path, kind, path2=others[number] if self.layout == "paired" else None))
        # parts without an end hold whole files, which stay tasks of their own
        tasks = tasks_for(sum(p.stop - p.start for p in parts if p.stop is not None), len(parts)) if all(p.stop is not None for p in parts) else len(parts)
        return [_Parts(parts[k * len(parts) // tasks : (k + 1) * len(parts) // tasks]) for k in range(tasks)] if parts else []

    def _pairs(self, part: _Part) -> Iterator[tuple]:
        first = records(part.path, part.kind)
        second = records(part.path2, self.kind) if part.path2 else first
        for k, a in enumerate(first):
            b = next(second, None)
            if b is None:
                raise FormatError(f"{part.path}: a read without its mate")
            yield (part.number << PLACE_BITS) + k, dict(zip(("name", "sequence", "qualities"), a[1:])), dict(zip(("name", "sequence", "qualities"), b[1:]))
        if part.path2 and next(second, None) is not None:
            raise FormatError(f"{part.path2}: more reads than in {part.path}")

    def read(self, parts: _Parts) -> Iterator[pa.RecordBatch]:
        if self.layout == "single":
            for part in parts.parts:
                yield from _single(part)
            return
        rows, schema = [], pa.schema([("read_idx", pa.int64()), ("r1", READ), ("r2", READ)])
        for row in chain.from_iterable(map(self._pairs, parts.parts)):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _single(part: _Part) -> Iterator[pa.RecordBatch]:
    with Part(part.path, part.start, part.stop) as opened:
        # a text's length isn't known before it is decompressed: there, records are counted from a number that those before can't reach
        base = (part.number << PLACE_BITS) + (part.start * RECORDS_A_BYTE if opened.members is not None else 0)
        count = 0
        for places, columns in blocks(opened, part.kind):
            order = places if opened.members is None else count + np.arange(len(places))
            count += len(places)
            yield pa.RecordBatch.from_arrays([pa.array(base + order), *columns()], names=["read_idx", *READ.names])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Reads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        return SINGLE if options.get("layout", "paired" if options.get("path2") else "single") == "single" else PAIRED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, path2: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(Reads)
    reader = spark.read.format("reads").option("path", path)
    for k, v in (options | ({"path2": path2} if path2 else {})).items():
        reader = reader.option(k, v)
    return reader.load()


def numbered(df: DataFrame, name: str = "number") -> tuple[DataFrame, int]:
    """Single reads with their number over all files, and how many there are. Records are counted in a pass of their own; a row for
    each part of a file goes to the driver."""
    part = F.spark_partition_id()
    counts = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    bases, total = [], 0
    for k in range(df.rdd.getNumPartitions()):
        bases.append(total)
        total += counts.get(k, 0)
    base = df.sparkSession.createDataFrame(list(enumerate(bases)), "_part int, _base long")
    df = df.drop("read_idx")
    placed = df.withColumns({"_part": part, "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base"), total


# --- pairs in parts -----------------------------------------------------------------------------------------------------
_MARK = "struct<number:long,path:string,place:long,skip:long>"


def marks(spark: SparkSession, path: str, every: int = EVERY, split: int = SPLIT) -> DataFrame:
    """An index of FASTQ files: number (over all files), path, place, skip (text to leave out from the place), reads (up to the next
    mark), file. A mark stands at the first record of each part and at every `every`-th after it. Each part is read once, by a
    task that small parts share; the marks are kept in the shared folder and numbered from there."""
    files, total = [], 0
    for n, p in enumerate(listed_files(path)):
        parts, stop = _ends(p, split)
        files.append((n, p, parts, stop, total))
        total += parts
    tasks = _tasks(files)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            found, count = [], 0
            with Part(row["path"], row["start"], row["stop"]) as part:
                for places, _ in blocks(part, "fastq"):
                    for k in range(-count % every, len(places), every):
                        found.append((count + k, *part.place(int(places[k]))))
                    count += len(places)
            if found:
                local, place, skip = (np.array(c, dtype=np.int64) for c in zip(*found))
                same = lambda c: pa.array([row[c]] * len(found))
                yield pa.RecordBatch.from_arrays(
                    [same("file").cast(pa.int32()), same("part").cast(pa.int32()), same("path"), pa.array(local), pa.array(place), pa.array(skip), pa.array(np.diff(np.append(local, count)))],
                    names=["file", "part", "path", "local", "place", "skip", "reads"],
                )

    listed = spark.createDataFrame(files, "file int, path string, parts long, end long, base long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    start = F.col("part") * split
    listed = listed.select("file", F.col("part").cast("int").alias("part"), "path", start.alias("start"), F.least(start + split, F.col("end")).alias("stop"), F.floor((F.col("base") + F.col("part")) * tasks / max(1, total)).cast("int").alias("task"))
    listed = listed.withColumn("stop", F.when(F.col("path").rlike(r"\.(bz2|xz)$"), None).otherwise(F.col("stop")))
    listed = listed.repartitionById(tasks, "task").drop("task")
    kept = scratch(spark, "marks")
    listed.mapInArrow(index, "file int, part int, path string, local long, place long, skip long, reads long").write.parquet(kept)
    found = spark.read.parquet(kept)
    within = Window.partitionBy("file").orderBy("part", "local").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("in_file", F.coalesce(F.sum("reads").over(within), F.lit(0)))
    # one row a file, so their running sum is one small task
    files = found.groupBy("file").agg(F.sum("reads").alias("of_file"))
    before = F.coalesce(F.sum("of_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(files.select("file", before.alias("base")), "file").select((F.col("base") + F.col("in_file")).alias("number"), "path", "place", "skip", "reads", "file")


class _Cursor:
    """The records of one side in order; opens a file at a mark only where it doesn't stand there already."""

    def __init__(self) -> None:
        self.path, self.number, self.stream = None, None, None

    def take(self, mark: dict, number: int, count: int) -> list[pa.Array]:
        """Names, sequences and qualities of `count` records from `number` on."""
        if (self.path, self.number) != (mark["path"], number):
            self.close()
            self.path, self.stream = mark["path"], open_at(mark["path"], mark["place"], mark["skip"])
            self.blocks, self.left = fastq_blocks(self.stream, self.path), None
            self._next(number - mark["number"])
        found = self._next(count)
        self.number = number + count
        return [pa.concat_arrays(c) for c in zip(*found)]

    def _next(self, count: int) -> list[list[pa.Array]]:
        found = []
        while count:
            if not self.left or not len(self.left[0]):
                block: Block | None = next(self.blocks, None)
                if block is None:
                    raise FormatError(f"{self.path}: fewer reads than when it was indexed")
                self.left = block[1]()
            found.append([c[:count] for c in self.left])
            self.left = [c[count:] for c in self.left]
            count -= len(found[-1][0])
        return found

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _lockstep(batches: Iterator[pa.RecordBatch], mates: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the ranges named; with one side, both reads of a pair are next to each other."""
    sides = [_Cursor() for _ in range(mates)]
    for row in (r for b in batches for r in b.to_pylist()):
        for start in range(row["number"], row["number"] + row["pairs"], BATCH):
            n = min(BATCH, row["number"] + row["pairs"] - start)
            if mates == 2:
                both = [c.take(row[f"m{k}"], start, n) for k, c in enumerate(sides, 1)]
            else:
                read = sides[0].take(row["m1"], 2 * start, 2 * n)
                both = [[c.take(pa.array(np.arange(k, 2 * n, 2))) for c in read] for k in (0, 1)]
            structs = [pa.StructArray.from_arrays(c, fields=list(READ)) for c in both]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), *structs], names=["read_idx", "r1", "r2"])
    for c in sides:
        c.close()


def read_pairs(spark: SparkSession, path: str, path2: str | None = None, every: int = EVERY, split: int | str = SPLIT) -> DataFrame:
    """Pairs of FASTQ files of any size, plain or gzip, in the order of the files: mates stand at equal places over all files of the
    two sides, or next to each other in interleaved files (without path2). read_idx numbers the pairs.

    Both sides are indexed by `marks`. Marks of both cut the numbers into ranges, and for each range
    the last mark of a side at or before it tells where to open it; so tasks read both sides in lockstep, and reads are never
    shuffled. Ranges are found in buckets of numbers; the last marks of a bucket are known to the next one as well."""
    mates, split = 2 if path2 else 1, int(split)
    index = reduce(DataFrame.unionByName, (marks(spark, p, every, split).withColumn("side", F.lit(k)) for k, p in enumerate((path, path2)[:mates], 1)))
    totals = [index.where(F.col("side") == k).agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("n")).first()["n"] for k in range(1, mates + 1)]
    if mates == 2 and totals[0] != totals[1]:
        raise FormatError(f"{path} has {totals[0]} reads and {path2} {totals[1]}: a read without its mate")
    if mates == 1 and not index.groupBy("file").agg(F.sum("reads").alias("n")).where("n % 2 = 1").isEmpty():
        raise FormatError(f"{path}: a read without its mate")
    pairs, wide = totals[0] // (3 - mates), 64 * every
    number = F.col("number") if mates == 2 else F.ceil(F.col("number") / 2).cast("long")  # of the first whole pair
    side = lambda k: F.when(F.col("side") == k, F.struct("number", "path", "place", "skip"))
    found = index.select(number.alias("pair"), *(side(k).alias(f"m{k}") for k in (1, 2)))
    bucket, rest = (F.col("pair") / wide).cast("long"), F.col("pair") % wide
    known = F.when(rest >= wide - every, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    none = [F.lit(None).cast(_MARK).alias(f"m{k}") for k in (1, 2)]
    starts = spark.range((pairs + wide - 1) // wide).select((F.col("id") * wide).alias("pair"), *none, F.col("id").alias("bucket"))
    cuts = found.withColumn("bucket", F.explode(known)).unionByName(starts).groupBy("bucket", "pair").agg(F.max("m1").alias("m1"), F.max("m2").alias("m2"))
    order = Window.partitionBy("bucket").orderBy("pair")
    last = lambda c: F.last(c, ignorenulls=True).over(order).alias(c)
    following = F.coalesce(F.lead("pair").over(order), F.least((F.col("bucket") + 1) * wide, F.lit(pairs)))
    ranges = cuts.select("bucket", "pair", last("m1"), last("m2"), (following - F.col("pair")).alias("pairs")).where("pair >= bucket * %d AND pairs > 0" % wide)
    tasks = min(pairs // every + 1, sum(_tasks([(n, f, *_ends(f, split), 0) for n, f in enumerate(listed_files(p))]) for p in (path, path2)[:mates]))
    ranges = ranges.withColumn("task", (F.col("pair") * tasks / max(pairs, 1)).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("pair")
    return ranges.select(F.col("pair").alias("number"), "pairs", "m1", "m2").mapInArrow(lambda batches: _lockstep(batches, mates), PAIRED)
