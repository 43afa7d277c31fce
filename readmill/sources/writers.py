"""Reads as FASTQ or FASTA text, written by Spark's text writer: a file for each task, compressed by its codec (by `bzip2` for .bz2).

Files in order of names hold the reads in the order of the DataFrame's partitions. That is the order of the input as long as
nothing shuffled them, as in a run over files; so the plan runs once and without a shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.sources import bzip2

#: How hard bzip2 compresses (1 to 9): at 1, the default of the tools users come from, blocks stay in the processor's cache.
LEVEL = 1
#: The same of Hadoop's gzip codec, as an option of the writer.
GZIP = {"zlib.compress.level": "BEST_SPEED"}


def lines(name: Column, sequence: Column, qualities: Column, kind: str | None = None) -> Column:
    """The text of a record; without a kind, FASTQ where there are qualities and FASTA where there are none."""
    fastq = F.concat(F.lit("@"), name, F.lit("\n"), sequence, F.lit("\n+\n"), F.coalesce(qualities, F.lit("")))
    fasta = F.concat(F.lit(">"), name, F.lit("\n"), sequence)
    return {"fastq": fastq, "fasta": fasta, None: F.when(qualities.isNull(), fasta).otherwise(fastq)}[kind]


def record(prefix: str = "", kind: str | None = None) -> Column:
    """The record of a row; prefix is that of a struct such as `r1.`."""
    return lines(F.col(f"{prefix}name"), F.col(f"{prefix}sequence"), F.col(f"{prefix}qualities"), kind)


def as_text(df: DataFrame, kind: str | None = None, prefix: str = "") -> DataFrame:
    """The column value."""
    return df.select(record(prefix, kind).alias("value"))


def _save(df: DataFrame, path: str, compression: str, by: tuple[str, ...] = (), together: bool = False) -> None:
    """The column value as lines, in folders by the others; with `together`, each task has the rows of a folder one after the other."""
    if compression not in ("none", "gzip", "bzip2"):
        raise ValueError(f"no writer for {compression!r}")
    if compression == "bzip2":
        bzip2.save(df if together or not by else df.sortWithinPartitions(*by), _opened_as(df, path), by, LEVEL)
        return
    df.write.partitionBy(*by).options(compression=compression, **GZIP).mode("overwrite").text(path)


def _opened_as(df: DataFrame, path: str) -> str:
    """The path that Spark would write to, as tasks in Python open it wherever they run."""
    system, where = _system(df, path)
    full = system.makeQualified(where(path)).toString()
    return re.sub("^/+", "/", full[len("file:") :]) if full.startswith("file:") else full


def write(df: DataFrame, path: str, kind: str | None = None, compression: str = "none", prefix: str = "", order: str | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Write reads. With `order` they are sorted by that column over all files, which runs the plan a second time for its bounds:
    store the DataFrame first where that matters."""
    if order is not None:
        df = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    _save(df.select(record(prefix, kind).alias("value"), *partition_by), path, compression, partition_by)


def write_pairs(df: DataFrame, path: str, kind: str | None = None, compression: str = "none") -> tuple[str, str]:
    """Both reads of pairs in one pass, with mates at the same places; returns the two folders."""
    each = F.posexplode(F.array(record("r1.", kind), record("r2.", kind))).alias("mate", "value")
    both = df.withColumn("_place", F.monotonically_increasing_id()).select("_place", each).select("value", (F.col("mate") + 1).alias("mate"), "_place")
    both = both.sortWithinPartitions("mate", "_place").select("value", "mate")
    _save(both, path, compression, ("mate",), True)
    return f"{path}/mate=1", f"{path}/mate=2"


def write_interleaved(df: DataFrame, path: str, kind: str | None = None, compression: str = "none") -> None:
    """Both reads of pairs in one output, one after the other."""
    _save(df.select(F.concat(record("r1.", kind), F.lit("\n"), record("r2.", kind)).alias("value")), path, compression)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); on one machine without it, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-reads-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}")
    # with its scheme, so that Python workers open it where Spark wrote it
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def kept(spark: SparkSession, what: str, n: int, turns: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of a job that writes files and reads them back in n turns, given by the path and the rows of each. The rows of a turn are kept as
    compressed columns and its files removed before the next ones are written, so the disk holds the files of one turn at a time. Those of
    a single turn stay, and its rows are read from them."""
    path = scratch(spark, f"{what}-rows")
    for files, rows in turns:
        if n == 1:
            return rows
        rows.write.mode("append").option("compression", "zstd").parquet(path)
        remove(rows, files)
    return spark.read.parquet(path)


def remove(df: DataFrame, path: str) -> None:
    """A folder that a writer has made."""
    system, where = _system(df, path)
    system.delete(where(path), True)


def _system(df: DataFrame, path: str):
    spark = df.sparkSession.sparkContext
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Names that would lead out of the folder they are put into, or be no folder of their own.
UNSAFE = r"^\.{0,2}$|[/\\\x00-\x1f]"


def _rename_all(df: DataFrame, staging: str, template: str, holes: list[str], overwrite: bool) -> list[str]:
    """Move each folder of the staging area to where its names lead: all targets are looked at before the first move."""
    system, where = _system(df, staging)
    unescape = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found: list[tuple[str, str]] = []

    def walk(folder: str, path: str, left: list[str]) -> None:
        if not left:
            found.append((folder, path))
            return
        for f in system.listStatus(where(folder)):
            key, _, value = f.getPath().getName().partition("=")
            if key == left[0]:
                value = unescape(value)
                if re.search(UNSAFE, value):
                    raise ValueError(f"{value!r} can't be the name of a folder")
                walk(f.getPath().toString(), path.replace("{" + key + "}", value), left[1:])

    walk(staging, template, holes)
    own = re.compile(r"part-.*|_SUCCESS|\..*\.crc")
    for _, path in found:
        if system.exists(where(path)):
            if not overwrite:
                raise FileExistsError(f"{path} is there already")
            if not all(f.isFile() and own.fullmatch(f.getPath().getName()) for f in system.listStatus(where(path))):
                raise FileExistsError(f"{path} holds more than what a writer has put there")
    for folder, path in found:
        target = where(path)
        if system.exists(target):
            system.delete(target, True)
        system.mkdirs(target.getParent())
        if not system.rename(where(folder), target):
            raise OSError(f"{folder} couldn't be moved to {path}")
    return sorted(path for _, path in found)


def write_named(
    df: DataFrame, template: str, names: tuple[Column, ...], kind: str | None = None, compression: str = "none", prefix: str = "", overwrite: bool = False
) -> list[str]:
    """Reads into a folder for each name: `{name}` (or `{name1}` and `{name2}`) in the template stands for it. Rows whose name is null
    are not written. One pass over df; the folders are renamed afterwards, one for each name. Returns them.

    Names come from the input, so one that is empty, `.` or `..`, or holds a separator, stops the job before anything has been moved. A folder
    that is there already is an error; with `overwrite` it is replaced if it holds nothing but files of such a writer."""
    holes = [f"name{k + 1}" if len(names) > 1 else "name" for k in range(len(names))]
    if any("{" + h + "}" not in template for h in holes):
        raise ValueError(f"{template!r} must hold {', '.join('{' + h + '}' for h in holes)}")
    known = df.select(record(prefix, kind).alias("value"), *(n.alias(h) for n, h in zip(names, holes))).dropna(subset=holes)
    return _save_named(known, template, holes, compression, overwrite)


def _save_named(known: DataFrame, template: str, holes: list[str], compression: str, overwrite: bool, order: str | None = None) -> list[str]:
    """The column value into a folder for each name, within a task in the order of a column that isn't written."""
    staging = f"{template.split('{')[0].rpartition('/')[0] or '.'}/_writing-{uuid.uuid4().hex[:12]}"
    safe = lambda n: F.when(n.rlike(UNSAFE), F.raise_error(F.concat(F.lit("not the name of a folder: "), n)).cast("string")).otherwise(n)
    known = known.withColumns({h: safe(F.col(h)) for h in holes})
    if order is not None:
        known = known.sortWithinPartitions(*holes, order).drop(order)
    try:
        _save(known, staging, compression, tuple(holes), order is not None)
        return _rename_all(known, staging, template, holes, overwrite)
    finally:
        system, where = _system(known, staging)
        system.delete(where(staging), True)


def write_fates(df: DataFrame, outputs: dict[str, str], kind: str | None = None, compression: str = "none", prefix: str = "") -> list[str]:
    """The reads of a run by what became of them, in one pass: outputs has a folder for each fate to be kept, such as `written`,
    `too_short`, `too_long` or `discard_untrimmed`; other reads are dropped."""
    folder, last = _one_folder(list(outputs.values()))
    return write_named(df, f"{folder}{{name}}", (_by_fate(dict(zip(outputs, last))),), kind, compression, prefix)


def _one_folder(paths: list[str]) -> tuple[str, list[str]]:
    """The folder that all paths lie in, with its separator, and their last names."""
    split = [p.rpartition("/") for p in paths]
    if len({s[0] for s in split}) > 1:
        raise ValueError("the outputs must lie in one folder")
    return split[0][0] + split[0][1], [s[2] for s in split]


def _by_fate(names: dict[str, str]) -> Column:
    name = F.lit(None).cast("string")
    for fate, to in names.items():
        name = F.when(F.col("fate") == fate, F.lit(to)).otherwise(name)
    return name


def write_pair_fates(df: DataFrame, outputs: dict[str, tuple[str, str]], kind: str | None = None, compression: str = "none") -> list[str]:
    """As `write_fates` for pairs, both sides in one pass: outputs has two folders for each fate, in whose files, taken in order of
    names, mates stand at the same places."""
    folder, last = _one_folder([p for both in outputs.values() for p in both])
    mates = F.array(*(F.struct(record(f"r{k + 1}.", kind).alias("value"), _by_fate(dict(zip(outputs, last[k::2]))).alias("name")) for k in (0, 1)))
    known = df.withColumn("_place", F.monotonically_increasing_id()).select("_place", F.explode(mates).alias("m")).select("m.value", "m.name", "_place").dropna(subset=["name"])
    return _save_named(known, f"{folder}{{name}}", ["name"], compression, False, "_place")
