"""Many adapters at once: an index from pieces of reads to the adapters that they may hold, so that a block of reads is passed over once, however many adapters there are.

Two indexes nominate pairs of a read and an adapter; nominated pairs, each read with an adapter of its own, are then aligned together.

* Pieces: an adapter can match only if one of its pieces stands exactly where it must (readmill.plans.windows). The first letters of all pieces are marked in one table of packed letters, and the letters at each
  place of a block are packed as the place moves on: a look into the table tells where pieces may begin, and only there are they compared in full.
* Left-out letters, for anchored adapters with insertions and deletions: two strings within k edits become equal if at most k letters are left out of each. The adapters' strings with letters left out lie in a sorted
  table; of a read's first (or last) letters, strings of each length that can match are made with letters left out, by shifting bits, for a whole block at a time. What both have in common nominates the pair. The pieces are then asked
  for as well, so that the same reads match as in a search of each adapter.

Adapters with other letters than A, C, G and T, and searches in which letters of reads are wildcards, are not indexed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from itertools import combinations

import numpy as np

from readmill.functions.letters import Letters, blocks
from readmill.operators.align import locate_pairs
from readmill.operators.alphabet import match_table
from readmill.plans.spec import Adapter, Single
from readmill.plans.windows import windows

#: Letters of a piece that are marked in the table; three bits each.
MARKED = 7
#: Errors of an anchored adapter for which strings with left-out letters are made, and letters that they may have.
MOST_LEFT_OUT, MOST_LETTERS = 2, 30
PAIRS = 1 << 16
_WHERE = ("all", "head", "tail")


def indexed(adapter: Adapter) -> bool:
    return isinstance(adapter, Single) and set(adapter.sequence) <= set("ACGT") and not adapter.read_wildcards and windows(adapter) is not None


def codes_of(adapter: Single) -> np.ndarray:
    """For each byte 0 to 3 if it equals A, C, G or T, else 4."""
    table = match_table("ACGT", adapter.adapter_wildcards, False)
    return np.where(table.any(0), table.argmax(0), 4).astype(np.uint8)


def letters(text: str) -> list[int]:
    return ["ACGT".index(c) for c in text]


class Pieces:
    """Where the adapters' pieces must stand: anywhere, in the first or in the last letters. tail pieces are held reversed, as they are looked for from the end."""

    def __init__(self, adapters: Sequence[Single]):
        found = defaultdict(list)  # where: (piece, adapter, letters that hold it)
        for k, a in enumerate(adapters):
            for (start, stop), pieces in windows(a).items():
                where = "tail" if start else "head" if stop is not None else "all"
                found[where] += [(letters(p[::-1] if start else p), k, -start if start else stop or 0) for p in pieces]
        self.at: dict[str, list[tuple]] = {}
        for where, entries in found.items():
            for marked in sorted({min(len(p), MARKED) for p, _, _ in entries}):
                mine = sorted((sum(c << 3 * (marked - 1 - i) for i, c in enumerate(p[:marked])), p, k, limit) for p, k, limit in entries if min(len(p), MARKED) == marked)
                value = np.array([v for v, *_ in mine])
                table = np.zeros(1 << 3 * marked, bool)
                table[value] = True
                size = np.array([len(p) for _, p, _, _ in mine])
                rest = np.full((len(mine), int(size.max())), 9, np.uint8)
                for row, (_, p, _, _) in zip(rest, mine):
                    row[: len(p)] = p
                self.at.setdefault(where, []).append((marked, table, value, size, rest, np.array([k for _, _, k, _ in mine]), np.array([x for *_, x in mine])))
        self.reach = {w: max(x for _, _, x in entries) for w, entries in found.items()}

    def nominate(self, codes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads and adapters, some pairs more than once. codes: [place, read]; tail: from the last letter on."""
        reads, adapters = [], []
        for where, groups in self.at.items():
            held = codes if where == "all" else codes[: self.reach[where]] if where == "head" else tail[: self.reach[where]]
            packed, n = held.astype(np.int32), 1
            for marked, table, value, size, rest, adapter, limit in groups:
                while n < marked and len(packed):
                    packed = packed[:-1] << 3
                    packed |= held[n : n + len(packed)]
                    n += 1
                if not len(packed):
                    break
                place, read = np.nonzero(table[packed])
                low, high = (np.searchsorted(value, packed[place, read], side=s) for s in ("left", "right"))
                times = high - low
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
                place, read = np.repeat(place, times), np.repeat(read, times)
                fits = place + size[entry] <= (limit[entry] if where != "all" else len(held))
                place, read, entry = place[fits], read[fits], entry[fits]
                for i in range(marked, rest.shape[1]):
                    if not len(entry):
                        break
                    on = size[entry] > i
                    same = ~on | (held[np.minimum(place + i, len(held) - 1), read] == rest[entry, i])
                    place, read, entry = place[same], read[same], entry[same]
                reads.append(read)
                adapters.append(adapter[entry])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *reads]), np.concatenate([none, *adapters])

    def stand(self, codes: np.ndarray, tail: np.ndarray, read: np.ndarray, adapter: np.ndarray) -> np.ndarray:
        """Whether a piece of the adapter stands where it must, for each pair."""
        if not len(read):
            return np.zeros(0, bool)
        columns, at = np.unique(read, return_inverse=True)
        r, k = self.nominate(codes[:, columns], tail[:, columns])
        return np.isin(at * (1 << 32) + adapter, r * (1 << 32) + k)


class LeftOut:
    """Anchored adapters of one length, within k insertions, deletions and mismatches of the letters at an end of reads."""

    def __init__(self, sequences: Sequence[str], k: int):
        self.m, self.k = len(sequences[0]), k
        pairs = {(self._pack([c for i, c in enumerate(letters(s)) if i not in out]), a) for a, s in enumerate(sequences) for d in range(k + 1) for out in combinations(range(self.m), d)}
        held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.value, self.adapter = np.ascontiguousarray(held[:, 0]), held[:, 1]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self._mark(self.value)] = True

    @staticmethod
    def _pack(codes: list[int]) -> int:
        """Two bits a letter, below a bit that tells how many there are."""
        value = 1
        for c in codes:
            value = value << 2 | c
        return value

    @staticmethod
    def _mark(value: np.ndarray) -> np.ndarray:
        return ((value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _without(self, packed: np.ndarray, size: int, n: int, below: int) -> list[np.ndarray]:
        """packed strings of `size` letters with n letters left out, each before `below` letters from the end at most."""
        if not n:
            return [packed]
        out = []
        for p in range(below):  # letters after the one that is left out
            rest = packed & np.int64((1 << 2 * p) - 1)
            out += self._without(packed >> np.int64(2 * p + 2) << np.int64(2 * p) | rest, size - 1, n - 1, p)
        return out

    def nominate(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads and adapters, some pairs more than once. codes: [place, read] from the end on which they are anchored, without any 4."""
        reads, adapters = [], []
        packed, size = np.ones(len(length), np.int64), 0
        for n in range(self.m + self.k + 1):
            if n:
                if n > len(codes):
                    break
                packed, size = packed << 2 | codes[n - 1], n
            if n < self.m - self.k:
                continue
            some = np.flatnonzero(length >= n)
            # with i letters more in the read and d in the adapter, n = m + i - d; mismatches are left out of both
            for out in range(max(0, n - self.m), self.k - max(0, self.m - n) + 1):
                for value in self._without(packed[some], size, out, size):
                    hit = np.flatnonzero(self.marks[self._mark(value)])
                    low, high = (np.searchsorted(self.value, value[hit], side=s) for s in ("left", "right"))
                    times = high - low
                    reads.append(np.repeat(some[hit], times))
                    adapters.append(self.adapter[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *reads]), np.concatenate([none, *adapters])


class _Class:
    """Adapters that differ in their letters alone."""

    def __init__(self, adapters: list[tuple[int, Single]]):
        self.number = np.array([k for k, _ in adapters])
        self.adapters = [a for _, a in adapters]
        one = self.adapters[0]
        self.pieces = Pieces(self.adapters)
        errors, self.suffix = int(one.rate * len(one.sequence)), one.kind == "suffix"
        small = one.anchored and errors <= MOST_LEFT_OUT and len(one.sequence) + errors <= MOST_LETTERS
        self.left_out = LeftOut([a.sequence[::-1] if self.suffix else a.sequence for a in self.adapters], errors) if small else None

    def nominate(self, codes: np.ndarray, tail: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.left_out is None:
            return self.pieces.nominate(codes, tail)
        held = (tail if self.suffix else codes)[: self.left_out.m + self.left_out.k]
        odd = ((held > 3) & (np.arange(len(held))[:, None] < length)).any(0)
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        r, k = self.left_out.nominate(held[:, plain], length[plain])
        r = plain[r]
        stand = self.pieces.stand(codes, tail, r, k)
        r2, k2 = self.pieces.nominate(codes[:, other], tail[:, other])
        return np.concatenate([r[stand], other[r2]]), np.concatenate([k[stand], k2])


class Index:
    """Of adapters with their numbers; all are `indexed`."""

    def __init__(self, adapters: Sequence[tuple[int, Single]]):
        alike = defaultdict(list)
        for k, a in adapters:
            alike[a.reverse, a.kind, len(a.sequence), a.rate, a.min_overlap, a.indels, a.adapter_wildcards, a.force_anywhere].append((k, a))
        self.classes = [(c, max([0, *c.pieces.reach.values()])) for c in map(_Class, alike.values())]
        self.codes = [codes_of(c.adapters[0]) for c, _ in self.classes]

    def find(self, reads: Letters, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[match, field]: the number of the read and of the adapter, and the six fields of the match."""
        out = [np.zeros((0, 8), np.int64)]
        for some in blocks(length):
            held = {}
            for (c, reach), table in zip(self.classes, self.codes):
                reverse = c.adapters[0].reverse
                most = max(reach, c.left_out.m + c.left_out.k if c.left_out else 0)
                if reverse not in held:
                    held[reverse] = reads.columns(start[some], length[some], reverse)
                codes = table[held[reverse]]
                n = np.minimum(length[some], most)
                tail = table[reads.columns(start[some] if reverse else start[some] + length[some] - n, n, not reverse)]
                r, k = c.nominate(codes, tail, length[some])
                pair = np.unique(r * (1 << 32) + k)
                r, k = pair >> 32, pair & ((1 << 32) - 1)
                for a in range(0, len(pair), PAIRS):
                    x, y = r[a : a + PAIRS], k[a : a + PAIRS]
                    found = locate_pairs(codes[:, x], length[some[x]], c.adapters, y)
                    hit = found[:, 5] >= 0
                    out.append(np.column_stack([some[x[hit]], c.number[y[hit]], found[hit]]).astype(np.int64))
        return np.concatenate(out)

    def best(self, reads: Letters, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same, of each read the match of the highest score, then the fewest errors, then the first adapter."""
        found = self.find(reads, start, length)
        found = found[np.lexsort((found[:, 1], found[:, 7], -found[:, 6], found[:, 0]))]
        return found[np.flatnonzero(np.diff(found[:, 0], prepend=-1))]
