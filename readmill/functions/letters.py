"""Arrow strings as matrices of letters, for functions that look at every letter of many reads at once.

A block holds reads of similar length as columns, a row for each place, so that a step along the reads is one operation on a
contiguous row. Letters are bytes (Latin-1; others count as `?`), places are counted in characters, and rows beyond a
read's end are 0. Everything here runs inside Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

#: Bytes of a block at most (a read longer than this has one of its own), and reads in one.
MOST_BYTES, MOST_READS = 1 << 21, 8192
SPAN = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])


def once(run: Callable, kind: DataType) -> Callable:
    """An Arrow UDF that the optimizer neither repeats nor moves: a filter on its result pushed down would run it a second time."""
    return F.arrow_udf(run, kind).asNondeterministic()


class Letters:
    """The letters of an Arrow string array, without a Python object for each."""

    def __init__(self, array: pa.Array):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        if array.null_count:
            array = array.fill_null("")
        array = array.cast(pa.large_string())
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        self.flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        #: Reads with letters beyond Latin-1.
        self.other = np.zeros(len(array), bool)
        if len(array) and at[-1] > at[0] and self.flat[at[0] : at[-1]].max() > 127:
            self.other = np.array([any(c > "\xff" for c in x) for x in array.to_pylist()])
            each = [x.encode("latin-1", "replace") for x in array.to_pylist()]
            self.flat = np.frombuffer(b"".join(each) or b"\0", np.uint8)
            at = np.cumsum([0, *map(len, each)])
        self.start, self.length = at[:-1], np.diff(at)

    def columns(self, start: np.ndarray, length: np.ndarray, reverse: bool = False) -> np.ndarray:
        """[place, read]: stretches of the letters."""
        out = np.zeros((int(length.max(initial=0)), len(length)), np.uint8)
        at = start + length - 1 if reverse else start.copy()
        least = int(length.min(initial=0))
        for j, row in enumerate(out):
            np.take(self.flat, at, out=row, mode="clip")  # a place beyond the end of a read gives whatever is there
            if j >= least:
                row *= j < length
            at += -1 if reverse else 1
        return out

    def blocks(self) -> Iterator[np.ndarray]:
        """The numbers of the reads, shorter ones first, in blocks."""
        yield from blocks(self.length)


def blocks(length: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        b = min(a + MOST_READS, len(order))
        while b - a > 1 and (b - a) * int(length[order[b - 1]]) > MOST_BYTES:
            b = a + (b - a) // 2
        yield order[a:b]
        a = b


def best_prefix(steps: Callable[[int], np.ndarray], length: np.ndarray) -> np.ndarray:
    """How many steps, from the first, have the greatest sum, as long as no sum before them is below zero."""
    total, best, at = (np.zeros(len(length), np.int32) for _ in range(3))
    over = np.zeros(len(length), bool)
    for j in range(int(length.max(initial=0))):
        total += steps(j)
        over |= (total < 0) | (j >= length)
        if over.all():
            break
        new = (total > best) & ~over
        np.copyto(best, total, where=new)
        np.copyto(at, j + 1, where=new)
    return at


def spans(start: np.ndarray, stop: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    fields = [pa.field("start", pa.int32()), pa.field("stop", pa.int32())]
    return pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], fields=fields, mask=null)


def quality_spans(front: int, back: int, base: int) -> Callable:
    def run(qualities: pa.Array) -> pa.Array:
        q = Letters(qualities)
        start, stop = np.zeros(len(q.length), np.int32), q.length.astype(np.int32)
        for some in q.blocks():
            for cutoff, reverse in ((front, False), (back, True)):
                if cutoff:
                    m = q.columns(q.start[some], q.length[some], reverse)
                    n = best_prefix(lambda j, m=m, limit=cutoff + base: limit - m[j].astype(np.int32), q.length[some])
                    if reverse:
                        stop[some] -= n
                    else:
                        start[some] = n
        nothing = start >= stop
        start[nothing] = stop[nothing] = 0
        return spans(start, stop, qualities.is_null())

    return once(run, SPAN)


def nextseq_spans(cutoff: int, base: int) -> Callable:
    def run(sequence: pa.Array, qualities: pa.Array) -> pa.Array:
        s, q = Letters(sequence), Letters(qualities)
        stop = s.length.astype(np.int32)
        for some in q.blocks():
            n = np.minimum(s.length[some], q.length[some])
            letter, quality = s.columns(s.start[some], s.length[some], True), q.columns(q.start[some], q.length[some], True)
            stop[some] -= best_prefix(lambda j, a=letter, b=quality: np.where(a[j] == ord("G"), 1, cutoff + base - b[j].astype(np.int32)).astype(np.int32), n)
        return spans(np.zeros_like(stop), stop, qualities.is_null())

    return once(run, SPAN)


def poly_spans(head: bool) -> Callable:
    wanted = ord("T" if head else "A")

    def run(sequence: pa.Array) -> pa.Array:
        s = Letters(sequence)
        cut = np.zeros(len(s.length), np.int32)
        for some in s.blocks():
            m, length = s.columns(s.start[some], s.length[some], not head), s.length[some]
            score, errors, best, at = (np.zeros(len(some), np.int32) for _ in range(4))
            for j in range(len(m)):
                hit = m[j] == wanted
                score += np.where(hit, 1, -2).astype(np.int32)
                errors += ~hit
                new = (score > best) & (errors * 5 <= j + 1) & (j < length)
                np.copyto(best, score, where=new)
                np.copyto(at, j + 1, where=new)
            cut[some] = np.where(at < 3, 0, at)
        size = s.length.astype(np.int32)
        return spans(cut, size, sequence.is_null()) if head else spans(np.zeros_like(cut), size - cut, sequence.is_null())

    return once(run, SPAN)


def error_sums(base: int) -> Callable:
    # the probability that each character stands for; none for rows beyond a read's end
    chance = np.power(10.0, (base - np.arange(256)) / 10.0)
    chance[0] = 0.0

    def run(qualities: pa.Array) -> pa.Array:
        q = Letters(qualities)
        total, bad = np.zeros(len(q.length)), np.zeros(len(q.length), bool)
        for some in q.blocks():
            m, length = q.columns(q.start[some], q.length[some]), q.length[some]
            here, low = np.zeros(len(some)), np.zeros(len(some), bool)
            for j in range(len(m)):
                here += chance[m[j]]
                low |= (m[j] < base) & (j < length)
            total[some], bad[some] = here, low
        return pa.array(total, pa.float64(), mask=bad | np.asarray(qualities.is_null()))

    return once(run, DoubleType())


def distances(first: np.ndarray, second: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of the columns of two matrices of letters, m and n letters long: a column of the table of costs is a bit
    vector of its differences, 64 rows to a word, and a letter of `second` is a step of all reads at once (Myers, Hyyroe)."""
    one, words, reads = np.uint64(1), max(1, -(-int(m.max(initial=0)) // 64)), np.arange(len(m))
    code = np.zeros(256, np.intp)
    held = np.unique(first[np.arange(len(first))[:, None] < m]) if len(first) else np.empty(0, np.uint8)
    code[held] = np.arange(1, len(held) + 1)
    equal = np.zeros((len(held) + 1, words, len(m)), np.uint64)  # of each letter, where it stands; 0 for all others
    for i, row in enumerate(first):
        equal[code[row], i // 64, reads] |= np.where(i < m, one << np.uint64(i % 64), np.uint64(0))
    up, down = np.full((words, len(m)), ~np.uint64(0)), np.zeros((words, len(m)), np.uint64)
    total, last, bit = m.astype(np.int64), np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
    for j, row in enumerate(second):
        letter, rise, fall = code[row], np.ones(len(m), np.uint64), np.zeros(len(m), np.uint64)
        for k in range(words):
            same = equal[letter, k, reads]
            vertical = same | down[k]
            same |= fall
            across = (((same & up[k]) + up[k]) ^ up[k]) | same
            more, less = down[k] | ~(across | up[k]), up[k] & across
            here = (last == k) & (j < n)
            total += np.where(here, ((more >> bit) & one).astype(np.int64) - ((less >> bit) & one).astype(np.int64), 0)
            top = np.uint64(63)
            rise, fall, more, less = more >> top, less >> top, more << one | rise, less << one | fall
            up[k], down[k] = less | ~(vertical | more), more & vertical
    return np.where(m == 0, n, total)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edit_distances() -> Callable:
    """The edit distance of two strings, a block of reads at a time."""

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        a, b = Letters(first), Letters(second)
        out = np.zeros(len(a.length), np.int32)
        longest = np.maximum(a.length, b.length)
        for some in blocks(longest):
            out[some] = distances(a.columns(a.start[some], a.length[some]), b.columns(b.start[some], b.length[some]), a.length[some], b.length[some])
        for k in np.flatnonzero(a.other | b.other):  # letters that a byte doesn't tell apart
            out[k] = _distance(first[int(k)].as_py() or "", second[int(k)].as_py() or "")
        return pa.array(out, pa.int32(), mask=np.asarray(first.is_null()) | np.asarray(second.is_null()))

    return once(run, IntegerType())
