"""The same plans over streams: trimming keeps no state, statistics are streaming aggregations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readmill.plans.pipeline import Options, run
from readmill.plans.report import counts, merged
from readmill.sources.fastq import BATCH, SINGLE, records


def read_stream(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """Single reads of the files of a folder as they arrive, each file once, in whatever order of names they come. Spark's file source
    keeps the files that it has seen in the checkpoint; only their paths pass through it. file_id (64 bits of a hash of the file's path) and read_idx (the place in
    it) together tell reads apart. Options are those of Spark's file source, such as maxFilesPerTrigger."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").options(**options).load(path).select("path")
    schema = pa.schema([("file_id", pa.int64()), ("read_idx", pa.int64()), *((c, pa.string()) for c in ("name", "sequence", "qualities"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                file_id = int.from_bytes(hashlib.blake2b(file.encode(), digest_size=8).digest(), "little", signed=True)
                found = records(file, kind)
                while rows := [(file_id, at, *read) for at, *read in islice(found, BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(read, f"file_id long, {SINGLE}")


def running_fates(df: DataFrame, options: Options) -> DataFrame:
    """fate, reads, bp: totals so far; write in update or complete mode."""
    out = run(df, options)
    return out.groupBy("fate").agg(F.count("*").alias("reads"), F.sum(F.length("sequence")).alias("bp"))


def write_trimmed(df: DataFrame, options: Options, path: str, checkpoint: str) -> StreamingQuery:
    """Trimmed reads that no filter takes, appended as Parquet with exactly-once output."""
    out = run(df, options).where("fate = 'written'").select(*[c for c in ("file_id", "read_idx") if c in df.columns], "name", "sequence", "qualities")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_counts(df: DataFrame, options: Options, path: str, checkpoint: str) -> StreamingQuery:
    """What reports are made of, as reads arrive: the counts of each batch go to a folder of its own, which a batch that is run again
    replaces, so each read counts once. `stored_counts` adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        counts(run(batch, options)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """The counts of all batches under the paths, as of one run; reports take them in place of a run's result."""
    return merged(*(spark.read.parquet(p).drop("batch") for p in paths))
