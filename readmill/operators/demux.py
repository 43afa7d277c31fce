"""Demultiplexing: reads into bins by the adapters found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions.reads import last_adapter
from readmill.sources.writers import write, write_named

UNKNOWN = "unknown"


def bin_of(matches: Column, unknown: str = UNKNOWN) -> Column:
    """The name of the last adapter found."""
    return last_adapter(matches, unknown)


def demultiplex(df: DataFrame, matches: str = "matches", discard_untrimmed: bool = False) -> DataFrame:
    """Adds bin; for pairs, give the first read's matches."""
    out = df.withColumn("bin", bin_of(F.col(matches)))
    return out.where(F.col("bin") != UNKNOWN) if discard_untrimmed else out


def demultiplex_pairs(df: DataFrame, first: str = "matches1", second: str = "matches2", discard_untrimmed: bool = False) -> DataFrame:
    """Adds bin1 and bin2: a bin for each combination."""
    out = df.withColumn("bin1", bin_of(F.col(first))).withColumn("bin2", bin_of(F.col(second)))
    return out.where((F.col("bin1") != UNKNOWN) & (F.col("bin2") != UNKNOWN)) if discard_untrimmed else out


def write_bins(df: DataFrame, path: str, columns: tuple[str, ...] = ("bin",), kind: str | None = None, prefix: str = "", compression: str = "none", overwrite: bool = False) -> None:
    """A folder for each bin, in one pass. With {name} in the path (or {name1} and {name2}) that stands for the bin, and folders that are there already stay."""
    if "{name" in path:
        write_named(df, path, tuple(F.col(c) for c in columns), kind, compression, prefix, overwrite)
    else:
        write(df, path, kind, compression, prefix, partition_by=columns)
