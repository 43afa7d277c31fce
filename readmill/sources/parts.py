"""Parts of FASTQ and FASTA files, each read by a task of its own.

A part holds the records that start after its first byte and at its end at the latest (the first part of a file also one at its
first byte), so a reader drops the rest of the line it starts in, and reads on past the part's end until its last record is whole.
Parts of gzip files are cut the same way, at members: a part takes the members that start in it. Where its first member starts is
found by its magic number and proved by its checksum; single-member files stay with their first part. FASTQ is cut into records
by numpy, a block of text at a time; text that isn't four lines to a record goes line by line, which also finds the errors.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into records at once, and bytes of a file read at once.
BLOCK = 4 << 20
CHUNK = 1 << 18
#: Bytes that are read beyond a part's end at first, for its last record.
TAIL = 1 << 13
BATCH = 16_384
#: Records that a byte of a gzip file can stand for at most: deflate makes up to 1032 bytes of one, and a record takes two.
RECORDS_A_BYTE = 516
#: Bytes of text by which a place that only looks like a member's start has shown it.
PROOF = 1 << 16
MAGIC = b"\x1f\x8b\x08"


class FormatError(ValueError):
    """A file that isn't FASTQ or FASTA as it should be."""


#: Schemes that Hadoop and pyarrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def located(path: str):
    """The file system and the path in it; without a scheme, the machine's own disk."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and rest.startswith("/"):
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return fs.LocalFileSystem(), path


def open_plain(path: str) -> BinaryIO:
    system, inner = located(path)
    return open(inner, "rb") if system.type_name == "local" else system.open_input_file(inner)


def open_any(path: str) -> BinaryIO:
    """A stream of the decompressed bytes."""
    plain = open_plain(path)
    for end, opened in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        if path.endswith(end):
            return opened(plain, "rb")
    return plain


# --- gzip members -------------------------------------------------------------------------------------------------------
def _proved(raw: BinaryIO, at: int, path: str, most: int | None = None) -> bool:
    """Whether a gzip member starts at `at`, by its checksum or, with `most`, by that many bytes of text. A member that breaks
    later than a false start would is an error, and so is one that the file ends in."""
    raw.seek(at)
    z, text = zlib.decompressobj(31), 0
    while not z.eof and (most is None or text < most):
        data = z.unconsumed_tail or raw.read(CHUNK)
        if not data and text > PROOF:
            raise FormatError(f"{path}: the file ends within the member at byte {at}")
        if not data:
            return False
        try:
            text += len(z.decompress(data, BLOCK))
        except zlib.error as e:
            if text > PROOF:
                raise FormatError(f"{path}: the member at byte {at} is damaged: {e}") from e
            return False
    return True


def next_member(raw: BinaryIO, start: int, stop: int, path: str) -> int | None:
    """Where the first gzip member in [start, stop) starts."""
    at, kept = start, b""
    while at - len(kept) < stop:
        raw.seek(at)
        data = raw.read(min(CHUNK, stop + len(MAGIC) - at))  # a start before the stop, and the byte after its magic number
        if not data:
            return None
        text, base, found = kept + data, at - len(kept), -1
        while 0 <= (found := text.find(MAGIC, found + 1)) and base + found < stop:
            flags = text[found + 3 : found + 4]  # the upper three bits are kept free
            if (not flags or flags[0] < 32) and _proved(raw, base + found, path):
                return base + found
        at, kept = at + len(data), text[-2:]
    return None


class Members(io.RawIOBase):
    """The text of the gzip members that start in [start, stop), followed by that of later ones for as long as it is read. `starts`
    has the place in the text and in the file of each member so far, `end` where the text of the part's own members ends."""

    def __init__(self, path: str, start: int, stop: int | None, proved: bool = False):
        self.path, self.stop, self.raw = path, stop, open_plain(path)
        self.first = start if start == 0 or proved else next_member(self.raw, start, stop, path)
        self.z, self.data, self.text, self.starts = None, b"", 0, []
        self.end: int | None = None if self.first is not None else 0
        self.next = self.first or 0
        self.raw.seek(self.next)

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.raw.close()
        super().close()

    def _begin(self) -> bool:
        """Start on the next member, if there is one."""
        while True:  # files may be filled up with zeros
            self.data = self.data or self.raw.read(CHUNK)
            zeros = len(self.data) - len(self.data.lstrip(b"\0"))
            self.next, self.data = self.next + zeros, self.data[zeros:]
            if self.data or not zeros:
                break
        if self.end is None and (not self.data or self.stop is not None and self.next >= self.stop):
            self.end = self.text
            if self.data:  # the part after this one starts here, and can't tell a broken start from none
                back = self.raw.tell()
                if not _proved(self.raw, self.next, self.path, 2 * PROOF):
                    raise FormatError(f"{self.path}: no gzip member at byte {self.next}")
                self.raw.seek(back)
        if not self.data:
            return False
        self.starts.append((self.text, self.next))
        self.z = zlib.decompressobj(31)
        return True

    def readinto(self, into) -> int:
        if self.first is None:
            return 0
        while True:
            if self.z is None and not self._begin():
                return 0
            self.data = self.data or self.raw.read(CHUNK)
            if not self.data:
                raise FormatError(f"{self.path}: the file ends within the member at byte {self.next}")
            try:
                out = self.z.decompress(self.data, len(into))
            except zlib.error as e:
                raise FormatError(f"{self.path}: the member at byte {self.next} is damaged: {e}") from e
            self.data = self.z.unconsumed_tail
            if self.z.eof:
                self.data, self.z = self.z.unused_data, None
                self.next = self.raw.tell() - len(self.data)
            self.text += len(out)
            if out:
                into[: len(out)] = out
                return len(out)

    def member(self, at: int) -> tuple[int, int]:
        """(place in the text, place in the file) of the member that the text at `at` is in."""
        return self.starts[bisect_right(self.starts, (at, 1 << 62)) - 1]


# --- parts --------------------------------------------------------------------------------------------------------------
Limit = Callable[[], float]


class Part:
    """An open part of a file: its text from `at` on, and `limit`, before which its records start."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        self.path, self.whole_lines, self.members = path, start == 0, None
        if path.endswith(".gz") and stop is not None:
            self.members = Members(path, start, stop)
            self.stream: BinaryIO = io.BufferedReader(self.members, CHUNK)
            self.base, self.limit = 0, lambda: float("inf") if self.members.end is None else self.members.end + 1
        else:
            self.stream = open_any(path)
            if start:
                self.stream.seek(start)
            self.base, self.limit = start, lambda: float("inf") if stop is None else stop + 1

    def place(self, at: int) -> tuple[int, int]:
        """Where to open the file, and how much of the text to leave out there, to be at `at`."""
        if self.members is None:
            return (0, at) if self.path.endswith((".gz", ".bz2", ".xz")) else (at, 0)
        text, file = self.members.member(at)
        return file, at - text

    def __enter__(self) -> Part:
        return self

    def __exit__(self, *_: object) -> None:
        self.stream.close()


def open_at(path: str, place: int, skip: int) -> BinaryIO:
    """The text from a place that `Part.place` gave."""
    if path.endswith(".gz"):
        stream: BinaryIO = io.BufferedReader(Members(path, place, None, proved=True), CHUNK)
    else:
        stream = open_any(path)
        stream.seek(place)
    while skip:
        skip -= len(stream.read(min(skip, BLOCK))) or skip
    return stream


class _Chained(io.RawIOBase):
    """What has been read ahead, then the rest of a stream."""

    def __init__(self, ahead: bytes, stream: BinaryIO):
        self.ahead, self.stream = ahead, stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.ahead[: len(into)] or self.stream.read(len(into))
        self.ahead = self.ahead[len(into) :]
        into[: len(data)] = data
        return len(data)


# --- records ------------------------------------------------------------------------------------------------------------
Record = tuple[int, str, str, str | None]
#: Places of records in the text, and what makes their names, sequences and qualities.
Block = tuple[np.ndarray, Callable[[], list[pa.Array]]]


def fastq_records(stream: BinaryIO, path: str, at: int = 0, limit: Limit = lambda: float("inf")) -> Iterator[Record]:
    """Records that start before the limit, line by line: place, name, sequence, qualities."""
    while at < limit():
        lines = [stream.readline()]
        while lines[0] and not lines[0].strip():  # blank lines between records
            at += len(lines[0])
            lines = [stream.readline()]
        if not lines[0] or at >= limit():
            return
        lines += [stream.readline() for _ in range(3)]
        name, sequence, plus, qualities = (x.rstrip(b"\r\n") for x in lines)
        if name[:1] != b"@" or plus[:1] != b"+":
            raise FormatError(f"{path}: no record at byte {at}: {name[:40]!r}")
        if not lines[3] and sequence:
            raise FormatError(f"{path}: the last record is cut off")
        if len(sequence) != len(qualities):
            raise FormatError(f"{path}: sequence and qualities of {name[1:].decode()!r} differ in length")
        yield at, name[1:].decode(), sequence.decode(), qualities.decode()
        at += sum(map(len, lines))


def fasta_records(stream: BinaryIO, path: str, at: int = 0, limit: Limit = lambda: float("inf"), first: bool = True) -> Iterator[Record]:
    """Records whose > stands before the limit, with the lines of each put together; text before the first one is an error at the
    start of a file, and belongs to the part before elsewhere."""
    name, parts, start = None, [], at
    for line in stream:
        text = line.strip().decode()
        if text.startswith(">"):
            if name is not None:
                yield start, name, "".join(parts), None
                name = None
            if at >= limit():
                return
            name, parts, start = text[1:], [], at
        elif name is not None:
            if text and not text.startswith("#"):
                parts.append(text)
        elif text and not text.startswith("#") and first:
            raise FormatError(f"{path}: text before the first record")
        elif at >= limit():
            return
        at += len(line)
    if name is not None:
        yield start, name, "".join(parts), None


def _is_record(lines: list[bytes]) -> bool:
    """No other line with @ has a + in the next line but one; a record that the file ends in counts, so that its reader says so."""
    return lines[0][:1] == b"@" and (lines[2][:1] == b"+" or not lines[2] and bool(lines[1].strip()))


def _to_first_record(stream: BinaryIO, at: int, limit: Limit) -> tuple[int, bytes]:
    """The place of the first record after the line that a part starts in, and what has been read from there."""
    at += len(stream.readline())
    lines = [stream.readline() for _ in range(4)]
    while lines[0] and at < limit() and not _is_record(lines):
        at += len(lines[0])
        lines = [*lines[1:], stream.readline()]
    return at, b"".join(lines)


def _listed(records: Iterator[Record]) -> Iterator[Block]:
    while rows := list(islice(records, BATCH)):
        places, *columns = zip(*rows)
        yield np.array(places, dtype=np.int64), lambda columns=columns: [pa.array(c, pa.string()) for c in columns]


def _arrays(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Names, sequences and qualities of records of four lines each: one array of pieces over the text as it is (the @, the name,
    its newline, ...), of which three of nine are taken."""
    n = len(starts) // 4
    cuts = np.empty((n, 9), dtype=np.int32)
    s, e = starts.reshape(n, 4), ends.reshape(n, 4)
    cuts[:, 0], cuts[:, 1], cuts[:, 2::2], cuts[:, 3::2] = s[:, 0], s[:, 0] + 1, e, s[:, 1:]
    offsets = np.append(cuts.ravel(), np.int32(ends[-1] + 1))
    pieces = pa.StringArray.from_buffers(9 * n, pa.py_buffer(offsets), pa.py_buffer(text))
    pieces.validate(full=True)
    return [pieces.take(pa.array(np.arange(k, 9 * n, 9))) for k in (1, 3, 7)]


def fastq_blocks(stream: BinaryIO, path: str, at: int = 0, limit: Limit = lambda: float("inf"), text: bytes = b"") -> Iterator[Block]:
    """Blocks of the records that start before the limit; `text` has been read from the stream already."""
    while at < limit():
        more = stream.read(max(int(min(BLOCK, max(limit() - at - len(text), 0) + TAIL)), len(text)))
        text += more
        letters = np.frombuffer(text, dtype=np.uint8)
        ends = np.flatnonzero(letters == 10)
        ends = ends[: len(ends) // 4 * 4]
        if not more or b"\r" in text:
            break
        if not len(ends):
            continue
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        sizes = ends - starts
        if (letters[starts[0::4]] != 64).any() or (letters[starts[2::4]] != 43).any() or (sizes[1::4] != sizes[3::4]).any():
            break
        places = at + starts[0::4]
        own = int(np.searchsorted(places, limit()))
        if own:
            yield places[:own], lambda t=text, s=starts[: 4 * own], e=ends[: 4 * own]: _arrays(t, s, e)
        if own < len(places):
            return
        at, text = at + int(ends[-1]) + 1, text[ends[-1] + 1 :]
    else:
        return
    yield from _listed(fastq_records(io.BufferedReader(_Chained(text, stream)), path, at, limit))


def blocks(part: Part, kind: str) -> Iterator[Block]:
    at = part.base
    if kind == "fasta":
        if not part.whole_lines:
            at += len(part.stream.readline())
        yield from _listed(fasta_records(part.stream, part.path, at, part.limit, part.whole_lines))
        return
    at, ahead = (at, b"") if part.whole_lines else _to_first_record(part.stream, at, part.limit)
    yield from fastq_blocks(part.stream, part.path, at, part.limit, ahead)
