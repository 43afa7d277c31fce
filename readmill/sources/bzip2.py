"""Text files compressed by bzip2, as a data source to write to: columns value and, if any, those that folders are named by.

Spark's own codec for them is Hadoop's in Java, as no native one comes with Spark; here each task compresses by Python's bz2. Files
and folders are those of Spark's text writer: a file for each task and folder, folders `column=value` with its escapes, a line for each row.
They are written beside their place and moved there when all tasks have ended. Any file system that pyarrow can open works.
"""

from __future__ import annotations

import bz2
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from readmill.sources.parts import located

#: What Spark's writers write as %XX in the names of folders, and the value of rows that have none.
ESCAPED = frozenset(map(chr, range(1, 32))) | frozenset("\"#%'*/:=?\\\x7f{[]^")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder(by: list[str], values: tuple[str | None, ...]) -> str:
    """The folder of the rows of these values."""
    escape = lambda x: "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in x)
    return "".join(f"{escape(b)}={escape(v) if v else NO_VALUE}/" for b, v in zip(by, values))


def lines(values: pa.Array) -> bytes:
    """A line for each value; one that is null is an empty line."""
    listed = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(pa.large_string()).fill_null(""))
    return pc.binary_join(listed, pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes() + b"\n" if len(values) else b""


def runs(keys: list[pa.Array], n: int) -> Iterator[tuple[int, int]]:
    """The stretches of rows of equal keys."""
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


class _File:
    def __init__(self, system, path: str, level: int):
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream, self.packed = system.open_output_stream(path, compression=None), bz2.BZ2Compressor(level)

    def write(self, text: bytes) -> None:
        self.stream.write(self.packed.compress(text))

    def close(self) -> None:
        self.stream.write(self.packed.flush())
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    #: Places below the folder of the output.
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, by: list[str], level: int, overwrite: bool):
        self.path, self.by, self.level, self.overwrite = path.rstrip("/"), by, level, overwrite
        self.staging = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = located(self.path)
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}"  # of this attempt
        files: list[str] = []
        held, last = None, None

        def begin(values: tuple) -> _File:
            files.append(f"{folder(self.by, values)}{name}-c{len(files):03d}.txt.bz2")
            return _File(system, f"{inner}/{self.staging}/{files[-1]}", self.level)

        for batch in iterator:
            keys = [batch.column(b) for b in self.by]
            for start, stop in runs(keys, len(batch)):
                values = tuple(k[start].as_py() for k in keys)
                if held is None or values != last:
                    if held is not None:
                        held.close()
                    held, last = begin(values), values
                held.write(lines(batch.column("value").slice(start, stop - start)))
        if held is None and number == 0 and not self.by:
            held = begin(())  # an output without rows has a file as well
        if held is not None:
            held.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, inner = located(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(inner)):
                if old.base_name != self.staging:
                    system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
        made = set()
        for file in (f for m in messages if m is not None for f in m.files):
            to = f"{inner}/{file}"
            if (parent := to.rpartition("/")[0]) not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            system.move(f"{inner}/{self.staging}/{file}", to)
        self._clear()
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What tasks have written, that of attempts that failed included."""
        from pyarrow import fs

        system, inner = located(self.path)
        if system.get_file_info(f"{inner}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staging}")


class Bzip2Text(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bzip2_text"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], [c for c in schema.names if c != "value"], int(self.options["level"]), overwrite)


def save(df: DataFrame, path: str, by: tuple[str, ...], level: int) -> None:
    """The rows of df, which stand together by the columns `by` in each partition, in place of what is at the path."""
    df.sparkSession.dataSource.register(Bzip2Text)
    columns = [F.col("value"), *(F.col(c).cast("string").alias(c) for c in by)]
    df.select(*columns).write.format("bzip2_text").option("path", path).option("level", level).mode("overwrite").save()
