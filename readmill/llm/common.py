"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank and U+0009..U+000D; `bytes.split()` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; only where that is unset (tests, one machine), below a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
        base = _own_dir[0]
    return qualified(spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme (and host) that Spark would give it: what has none lies on the default file system of the cluster, and
    workers that open it by themselves must look there and not on their own disk."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_rows: int = 1000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about most_bytes, so that the Python objects made of one are few; a single row may be longer."""
    for batch in batches:
        step = max(1, min(most_rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of the batches. At a task's end Arrow's spare memory goes back, as workers serve later stages too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(slices(batches))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class Remembered:
    """A memory of the most used entries: once `now` holds about `most_bytes`, it becomes the older half, from which entries
    return when used."""

    #: What an entry takes beside the bytes of its key and value: two objects and its place in the dictionary.
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.most, self.held = most_bytes // 2, 0
        self.now: dict = {}
        self.older: dict = {}

    def seen(self, key):
        """An entry that isn't in `now`, if the older half has it."""
        found = self.older.get(key)
        return found if found is None else self.put(key, found)

    def put(self, key, value, size: int = 0):
        self.held += self.ENTRY + len(key) + size
        if self.held >= self.most:
            self.older, self.now, self.held = self.now, {}, 0
        self.now[key] = value
        return value


#: Pieces of text longer than this are cut where they can be.
LONG = 1 << 16
#: Places that the splitter of a vocabulary that drops white space cuts at: around digits, and between letters and marks.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[.,;:!?#$%&*()+\-/=@\[\]^_`{}~\"\\])|(?<=[0-9])(?=[A-Za-z0-9])|(?<=[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def safe_parts(piece: bytes, most: int = LONG) -> Iterator[bytes]:
    """A piece in parts of `most` bytes and more, cut where no token crosses; as a whole if it is short or has no such place."""
    if len(piece) <= most:
        yield piece
        return
    text, a = piece.decode(), 0
    while (m := _SAFE.search(text, a + most // 4 + 1)) is not None:  # a character has four bytes at most
        yield text[a : m.start()].encode()
        a = m.start()
    yield text[a:].encode()


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_rng = np.random.default_rng(20_240_229)
#: Fixed odd multipliers for windows of up to 64 words; two rows for two independent hashes.
_MULTIPLIERS = _rng.integers(1, 1 << 63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: For words: a random value for each byte (none for white space), and powers of a random odd number with their inverses.
_BYTES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_SPACE] = 0
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _powers


def _hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    if not len(edge):
        return np.empty(0, np.uint64)
    start, stop = edge[::2], edge[1::2] - 1
    power, inverse = _tables(len(a))
    values = _BYTES[a]
    values *= power[: len(a)]
    first = values[start]
    np.cumsum(values, out=values)
    return mixed((values[stop] - values[start] + first) * inverse[start])


def _long_word(word: bytes) -> np.ndarray:
    """The hash of one word, block by block."""
    total, power = 0, _tables(_PIECE)[0]
    for a in range(0, len(word), _PIECE):
        block = _BYTES[np.frombuffer(word, np.uint8, min(_PIECE, len(word) - a), a)]
        total += int((block * power[: len(block)]).sum(dtype=np.uint64)) * pow(_BASE, a, 1 << 64)
    return mixed(np.array([total * _INVERSE % (1 << 64)], np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text: polynomials over its bytes, from running sums over stretches of the text that end
    at white space; memory beside the text and the result stays within a few stretches, whatever the words' lengths."""
    if len(text) <= _PIECE:
        return _hashes(text)
    out, a = [], 0
    while a < len(text):
        found = _WHITE.search(text, a + _PIECE)
        b = found.start() if found else len(text)
        if b - a > 2 * _PIECE:  # the stretch ends in a long word
            k = max(a, 1 + max(text.rfind(c, a, a + _PIECE) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
            out += [_hashes(text[a:k]), _long_word(text[k:b])]
        else:
            out.append(_hashes(text[a:b]))
        a = b
    return np.concatenate(out)


def window_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of each n consecutive words, from the hashes of the words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j : j + m] * _MULTIPLIERS[which, j]
    return mixed(out)


def row_key(id_column: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart: rows with one id and different texts get different keys, equal rows share one."""
    return [F.col(id_column), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
