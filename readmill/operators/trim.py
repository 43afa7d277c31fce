"""Adapter trimming: an Arrow UDF over the sequences alone finds adapters, and Column functions apply what was found.

In the UDF, pieces of an adapter are looked for at all places of a block of reads at once, and only reads that hold one are
aligned. `find_adapters` adds `matches`, an array of structs, one for each adapter part found, in the order found:
adapter, side (before/after: what a trim removes), part (0 single, 1 and 2 of a linked adapter), astart, astop, rstart, rstop
(places in the read as that round saw it), score, errors, from and to (that round's read as an interval of the whole read).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from readmill.functions.letters import Letters, blocks, once
from readmill.functions.reads import cut, interval, reverse_complement
from readmill.operators.align import locate_columns
from readmill.operators.alphabet import matching_letters
from readmill.operators.index import Index, indexed
from readmill.plans.spec import Adapter, Linked, Single
from readmill.plans.windows import pattern, windows

_NUMBERS = ("part", "astart", "astop", "rstart", "rstop", "score", "errors", "from", "to")
MATCHES = ArrayType(StructType([StructField("adapter", StringType()), StructField("side", StringType()), *(StructField(n, IntegerType()) for n in _NUMBERS)]))
_MATCH = pa.struct([("adapter", pa.string()), ("side", pa.string()), *((n, pa.int32()) for n in _NUMBERS)])
#: From so many adapters on that can be indexed they are.
MANY = 2
ACTIONS = ("trim", "mask", "lowercase", "retain", "crop", "none")


def _windowed(adapter: Single) -> list[tuple[int, int | None, str]] | None:
    found = windows(adapter)
    return None if found is None else [(a, b, pattern(p, adapter)) for (a, b), p in sorted(found.items(), key=str)]


def can_match(sequence: Column, adapter: Adapter) -> Column:
    """Whether a piece of the adapter stands where it must for a match: expressions that stay in the JVM."""
    if isinstance(adapter, Linked):
        parts = [can_match(sequence, p) for p, need in ((adapter.front, adapter.front_required), (adapter.back, adapter.back_required)) if need]
        # the back part is searched for in what the front leaves, so only the front's windows hold for the whole read
        return parts[0] if adapter.front_required else F.lit(True)
    marks = _windowed(adapter)
    if marks is None:
        return F.lit(True)
    if adapter.reverse:
        sequence = F.reverse(sequence)
    tests = []
    for start, stop, regex in marks:
        part = sequence if (start, stop) == (0, None) else F.substring(sequence, 1, stop) if stop is not None else F.when(F.length(sequence) <= -start, sequence).otherwise(F.substring(sequence, start, -start))
        tests.append(part.rlike(regex))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


class _Finder:
    """Best matches of one adapter part in stretches of many reads."""

    def __init__(self, adapter: Single):
        self.adapter = adapter
        self.windows = windows(adapter)
        different = sorted({c for pieces in (self.windows or {}).values() for p in pieces for c in p})
        self.bit = {c: np.uint32(1 << k) for k, c in enumerate(different)}
        self.bits = np.zeros(256, np.uint32)
        for c in different:
            for letter in matching_letters(c, adapter.adapter_wildcards, adapter.read_wildcards):
                self.bits[ord(letter)] |= self.bit[c]

    def _holds(self, letters: np.ndarray, pieces: set[str]) -> np.ndarray:
        """Which reads hold one of the pieces. letters: [place, read]."""
        found = np.zeros(letters.shape[1], bool)
        codes = self.bits[letters]
        equal = {c: (codes & self.bit[c]) != 0 for c in {c for p in pieces for c in p}}
        for p in pieces:
            n = len(letters) - len(p) + 1
            if n > 0:
                here = equal[p[0]][:n].copy()
                for k, c in enumerate(p[1:], 1):
                    here &= equal[c][k : n + k]
                found |= here.any(0)
        return found

    def possible(self, letters: np.ndarray, reads: Letters, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a piece of the adapter stands where it must for a match. letters: of the stretches, in the adapter's direction."""
        if self.windows is None:
            return np.ones(len(length), bool)
        found = np.zeros(len(length), bool)
        ends = [-a for a, b in self.windows if b is None and a]
        if ends:
            n = np.minimum(length, max(ends))
            # from the last letter on, so that a window at the end is the first rows
            tail = reads.columns(start if self.adapter.reverse else start + length - n, n, not self.adapter.reverse)
        for (a, b), pieces in self.windows.items():
            if a:
                found |= self._holds(tail[:-a], {p[::-1] for p in pieces})
            else:
                found |= self._holds(letters[:b], pieces)
        return found

    def find(self, reads: Letters, start: np.ndarray, length: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """[stretch, field], errors -1 where there is no match."""
        out = np.full((len(length), 6), -1, np.int32)
        for some in blocks(length):
            if wanted is not None:
                some = some[wanted[some]]
            if not len(some):
                continue
            letters = reads.columns(start[some], length[some], self.adapter.reverse)
            at = np.flatnonzero(self.possible(letters, reads, start[some], length[some]))
            if len(at):
                out[some[at]] = locate_columns(letters[:, at], length[some[at]], self.adapter)
        return out

    def before(self, found: np.ndarray) -> np.ndarray:
        """Whether the matches remove what is before them."""
        fixed = self.adapter.removes_before
        return found[:, 2] == 0 if fixed is None else np.full(len(found), fixed)


class _Search:
    """Rounds of a search for all adapters; of several matches the highest score counts, then the fewest errors, then the first."""

    def __init__(self, adapters: Sequence[Adapter], times: int):
        self.adapters, self.times = adapters, times
        many = [(k, a) for k, a in enumerate(adapters) if indexed(a)]
        self.index = Index(many) if len(many) >= MANY else None
        self.apart = [k for k, a in enumerate(adapters) if self.index is None or not indexed(a)]
        self.finders = [(_Finder(a.front), _Finder(a.back)) if isinstance(a, Linked) else (_Finder(a),) for a in adapters]

    def _one(self, k: int, reads: Letters, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second part of adapter k in each stretch (the second of a linked one, in what its first part leaves)."""
        adapter, finders = self.adapters[k], self.finders[k]
        first = finders[0].find(reads, start, length)
        second = np.full_like(first, -1)
        if isinstance(adapter, Linked):
            hit = first[:, 5] >= 0
            gone = np.where(hit, first[:, 3], 0)
            second = finders[1].find(reads, start + gone, length - gone, hit | (not adapter.front_required))
            fails = ~hit if adapter.front_required else np.zeros(len(hit), bool)
            fails |= (second[:, 5] < 0) & (~hit | adapter.back_required)
            first[fails] = second[fails] = -1
        return first, second

    def _best(self, reads: Letters, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = np.full(len(start), -1)
        parts = [np.full((len(start), 6), -1, np.int32) for _ in range(2)]
        top, fewest = np.zeros(len(start), int), np.zeros(len(start), int)
        for k in self.apart:
            found = self._one(k, reads, start, length)
            score, errors = (sum(np.where(f[:, 5] >= 0, f[:, c], 0) for f in found) for c in (4, 5))
            better = (found[0][:, 5] >= 0) | (found[1][:, 5] >= 0)
            better &= (chosen < 0) | (score > top) | ((score == top) & (errors < fewest))
            chosen[better], top[better], fewest[better] = k, score[better], errors[better]
            for held, f in zip(parts, found):
                held[better] = f[better]
        if self.index is not None:
            found = self.index.best(reads, start, length)
            read, k, score, errors = found[:, 0], found[:, 1], found[:, 6], found[:, 7]
            ahead = (score > top[read]) | (score == top[read]) & ((errors < fewest[read]) | (errors == fewest[read]) & (k < chosen[read]))
            better = (chosen[read] < 0) | ahead
            chosen[read[better]] = k[better]
            parts[0][read[better]], parts[1][read[better]] = found[better, 2:], -1
        return chosen, *parts

    def __call__(self, sequence: pa.Array) -> pa.Array:
        reads = Letters(sequence)
        n = len(reads.length)
        a, b = np.zeros(n, np.int64), reads.length.astype(np.int64)  # what is left of each read
        active, rows = np.arange(n), []
        for _ in range(self.times):
            if not len(active):
                break
            chosen, first, second = self._best(reads, reads.start[active] + a[active], b[active] - a[active])
            hit = np.flatnonzero(chosen >= 0)
            read, chosen, first, second = active[hit], chosen[hit], first[hit], second[hit]
            left, right = a[read].copy(), b[read].copy()
            for k, adapter in enumerate(self.adapters):
                mine = chosen == k
                linked = isinstance(adapter, Linked)
                for part, (f, finder) in enumerate(zip((first, second), self.finders[k])):
                    at = np.flatnonzero(mine & (f[:, 5] >= 0))
                    if not len(at):
                        continue
                    f, before = f[at], finder.before(f[at])
                    number = np.full(len(at), part + linked)
                    rows.append(np.column_stack([read[at], np.full(len(at), k), before, number, f, left[at], right[at]]))
                    # only now does what is left shrink: the second part of a linked adapter is counted from there
                    left[at], right[at] = np.where(before, left[at] + f[:, 3], left[at]), np.where(before, right[at], left[at] + f[:, 2])
            a[read], b[read] = left, right
            active = read[right > left]
        return self._array(np.concatenate(rows) if rows else np.zeros((0, 12), np.int64), n)

    def _array(self, rows: np.ndarray, n: int) -> pa.Array:
        """rows: read, adapter, before, part, the six fields, from, to; those of a read in the order in which they were found."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        offsets = np.searchsorted(rows[:, 0], np.arange(n + 1)).astype(np.int32)
        name = pa.array([a.name for a in self.adapters], pa.string()).take(pa.array(rows[:, 1]))
        side = pa.array(["after", "before"]).take(pa.array(rows[:, 2]))
        numbers = [pa.array(rows[:, c].astype(np.int32)) for c in range(3, 12)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([name, side, *numbers], fields=list(_MATCH)))


def adapters_in(sequence: Column, adapters: Sequence[Adapter], times: int = 1) -> Column:
    """The matches in a column of sequences: up to `times` rounds, each on what the one before left, until none is found or nothing is left."""
    if not adapters:
        return F.array().cast(MATCHES)
    return once(_Search(list(adapters), times).__call__, MATCHES)(F.coalesce(sequence, F.lit("")))


def find_adapters(df: DataFrame, adapters: Sequence[Adapter], times: int = 1, sequence: str = "sequence", matches: str = "matches") -> DataFrame:
    """Adds `matches`."""
    return df.withColumn(matches, adapters_in(F.col(sequence), adapters, times))


def left_of(matches: Column, size: Column) -> Column:
    """The interval of the whole read that trimming leaves."""
    last = F.try_element_at(matches, F.lit(-1))
    after = F.when(last["side"] == "before", interval(last["from"] + last["rstop"], last["to"])).otherwise(interval(last["from"], last["from"] + last["rstart"]))
    return F.when(F.size(matches) > 0, after).otherwise(interval(0, size))


def retained(matches: Column, size: Column) -> Column:
    """The interval with the adapter of the last round: what lies beyond it goes."""
    last = F.try_element_at(matches, F.lit(-1))
    # a linked adapter's two parts are the last two entries of one round
    before = F.when((last["part"] == 2) & (F.size(matches) > 1), F.try_element_at(matches, F.greatest(F.size(matches) - 1, F.lit(1))))
    start = F.when(before["part"] == 1, before["from"] + before["rstart"]).when(last["side"] == "before", last["from"] + last["rstart"]).otherwise(last["from"])
    stop = F.when(last["side"] == "before", last["to"]).otherwise(last["from"] + last["rstop"])
    return F.when(F.size(matches) > 0, interval(start, stop)).otherwise(interval(0, size))


def matched(matches: Column, size: Column) -> Column:
    last = F.try_element_at(matches, F.lit(-1))
    return F.when(F.size(matches) > 0, interval(last["from"] + last["rstart"], last["from"] + last["rstop"])).otherwise(interval(0, size))


def apply_action(df: DataFrame, action: str = "trim", sequence: str = "sequence", qualities: str = "qualities", matches: str = "matches") -> DataFrame:
    """The reads after the action on what was found: sequence and qualities change together."""
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {ACTIONS}")
    if action == "none":
        return df
    s, q, m = F.col(sequence), F.col(qualities), F.col(matches)
    held = free_name(df, "_span")
    df = df.withColumn(held, {"retain": retained, "crop": matched}.get(action, left_of)(m, F.length(s)))
    span = F.col(held)
    if action in ("mask", "lowercase"):
        head, inner, tail = F.substring(s, F.lit(1), span["start"]), cut(s, span), F.substring(s, span["stop"] + 1, F.length(s))
        if action == "mask":
            new = F.concat(F.repeat(F.lit("N"), F.length(head)), inner, F.repeat(F.lit("N"), F.length(tail)))
        else:
            new = F.concat(F.lower(head), F.upper(inner), F.lower(tail))
        return df.withColumn(sequence, new).drop(held)
    return df.withColumns({sequence: cut(s, span), qualities: cut(q, span)}).drop(held)


def trim(df: DataFrame, adapters: Sequence[Adapter], times: int = 1, action: str = "trim") -> DataFrame:
    return apply_action(find_adapters(df, adapters, times), action)


def total_score(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda a, x: a + x["score"])


def free_name(df: DataFrame, name: str) -> str:
    """A name of no column of df."""
    while name in df.columns:
        name = "_" + name
    return name


def best_strand(df: DataFrame, adapters: Sequence[Adapter], times: int = 1, suffix: str = " rc") -> DataFrame:
    """Adapters searched for in reads and in their reverse complements; the strand with the higher score stays. Adds is_rc."""
    here, there = free_name(df, "_here"), free_name(df, "_there")
    turned = reverse_complement(F.col("sequence"))
    both = df.withColumns({here: adapters_in(F.col("sequence"), adapters, times), there: adapters_in(turned, adapters, times)})
    is_rc = (F.size(there) > 0) & ((F.size(here) == 0) | (total_score(F.col(there)) > total_score(F.col(here))))
    pick = lambda a, b: F.when(is_rc, b).otherwise(a)
    out = both.withColumns({
        "is_rc": is_rc, "sequence": pick(F.col("sequence"), turned), "qualities": pick(F.col("qualities"), F.reverse("qualities")), "matches": pick(F.col(here), F.col(there)),
        "name": pick(F.col("name"), F.concat("name", F.lit(suffix))),
    })
    return out.drop(here, there)


def pair_adapters(df: DataFrame, first: Sequence[Adapter], second: Sequence[Adapter], matches: tuple[str, str] = ("matches1", "matches2"), sequences: tuple[Column | str, Column | str] = ("sequence1", "sequence2")) -> DataFrame:
    """The adapters are pairs: the i-th of each list must both be found, in one read each; the best such pair counts, or none."""
    if len(first) != len(second):
        raise ValueError("pair_adapters needs as many adapters for the second reads as for the first")
    held = free_name(df, "_pairs")
    reads = [F.col(c) if isinstance(c, str) else c for c in sequences]
    # all searches are one pass through Python: their results stand side by side in one column
    pairs = F.array(*[F.struct(F.lit(-k).alias("k"), adapters_in(reads[0], [a]).alias("a"), adapters_in(reads[1], [b]).alias("b")) for k, (a, b) in enumerate(zip(first, second))])
    both = F.filter(F.col(held), lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0))
    ranked = F.transform(both, lambda p: F.struct((total_score(p["a"]) + total_score(p["b"])).alias("score"), p["k"].alias("k"), p["a"].alias("a"), p["b"].alias("b")))
    best = free_name(df, "_best")
    found = df.withColumn(held, pairs).withColumn(best, F.array_max(ranked))
    none = F.array().cast(MATCHES)
    return found.withColumns({m: F.coalesce(F.col(best)[c], none) for m, c in zip(matches, "ab")}).drop(held, best)


def anchored_hamming(sequence: Column, adapter: str, rate: float, suffix: bool = False) -> Column:
    """Mismatches of an anchored adapter without wildcards and indels, null where there are too many: no Python at all."""
    m = len(adapter)
    part = F.upper(F.substring(sequence, -m, m) if suffix else F.substring(sequence, 1, m))
    errors = sum((F.substring(part, k + 1, 1) != c).cast("int") for k, c in enumerate(adapter.upper()))
    return F.when((F.length(sequence) >= m) & (errors <= int(rate * m)), errors)


def neighbours(sequence: str, k: int) -> dict[str, int]:
    """All strings at Hamming distance up to k, with their distance."""
    found = {sequence: 0}
    for d in range(1, k + 1):
        for s, e in list(found.items()):
            if e == d - 1:
                for i in range(len(s)):
                    for c in "ACGT":
                        found.setdefault(s[:i] + c + s[i + 1 :], d)
    return found


def edit_neighbours(sequence: str, k: int) -> dict[str, int]:
    """All strings over ACGT at edit distance up to k, with their distance."""
    found, edge = {sequence: 0}, [sequence]
    for d in range(1, k + 1):
        new = []
        for s in edge:
            options = [s[:i] + s[i + 1 :] for i in range(len(s))] + [s[:i] + c + s[j:] for i in range(len(s) + 1) for c in "ACGT" for j in (i, i + 1) if j <= len(s)]
            for t in options:
                if t not in found:
                    found[t] = d
                    new.append(t)
        edge = new
    return found


def _indexed(adapter: Adapter) -> bool:
    return isinstance(adapter, Single) and adapter.anchored and not adapter.indels and set(adapter.sequence.upper()) <= set("ACGT")


def _searched(df: DataFrame, adapters: Sequence[Adapter]) -> DataFrame:
    """Adds adapter and errors of the match of reads that have one."""
    m = free_name(df, "_matches")
    found = find_adapters(df, adapters, matches=m).where(F.size(m) > 0)
    return found.select(*df.columns, F.col(m)[0]["adapter"].alias("adapter"), F.col(m)[0]["errors"].alias("errors"))


def index_join(df: DataFrame, adapters: Sequence[Single], most_rows: int = 200_000) -> DataFrame:
    """Many anchored adapters of fixed errors at once: an equality join of each read's start (end) with all strings near an adapter.

    Reads with other letters than A, C, G, T there are searched, and all reads are if an adapter allows indels (find_adapters has an index of
    left-out letters for those), has wildcards, isn't anchored or has so many strings near it that the tables would not fit the driver. Up to `most_rows` rows in all the
    tables, which are built on the driver, are broadcast."""
    if not adapters or not all(_indexed(a) for a in adapters) or sum(near_size(a) for a in adapters) > 20 * most_rows:
        return _searched(df, adapters)
    near: dict[tuple[bool, int], dict[str, tuple[int, int, int, str]]] = {}  # of each end and size, the best adapter of each string
    for k, a in enumerate(adapters):
        n = len(a.sequence)
        best = near.setdefault((a.kind == "suffix", n), {})
        for s, e in neighbours(a.sequence.upper(), int(a.rate * n)).items():
            best[s] = min(best.get(s, (n + 1, 0, 0, "")), (2 * e - n, e, k, a.name))
    few = sum(map(len, near.values())) <= most_rows
    end = lambda suffix, n: F.upper(F.substring("sequence", -n if suffix else 1, n))
    plain = F.lit(True)
    for suffix in {x for x, _ in near}:
        plain = plain & end(suffix, max(n for x, n in near if x == suffix)).rlike("^[ACGT]*$")
    plain, hit = F.coalesce(plain, F.lit(False)), free_name(df, "_hit")
    hits, held = df.where(plain), []
    for (suffix, n), best in near.items():
        held.append(free_name(df, f"_hit{'s' * suffix}{n}"))
        table = df.sparkSession.createDataFrame(list(best.items()), f"`{held[-1]}_near` string, `{held[-1]}` struct<cost:int,errors:int,k:int,adapter:string>")
        hits = hits.join(F.broadcast(table) if few else table, end(suffix, n) == F.col(f"{held[-1]}_near"), "left")
    hits = hits.withColumn(hit, F.array_min(F.array(*held))).where(F.col(hit).isNotNull())
    return hits.select(*df.columns, F.col(hit)["adapter"].alias("adapter"), F.col(hit)["errors"].alias("errors")).unionByName(_searched(df.where(~plain), adapters))


def near_size(adapter: Single) -> int:
    """How many strings lie near an anchored adapter without indels."""
    n = len(adapter.sequence)
    return sum(math.comb(n, e) * 3**e for e in range(int(adapter.rate * n) + 1))
