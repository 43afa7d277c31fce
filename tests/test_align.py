"""The vectorised alignment against a plain one, cell by cell, and against known results."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readmill.operators.align import locate
from readmill.operators.alphabet import equal
from readmill.plans.spec import KINDS, START_ADAPTER, START_READ, STOP_ADAPTER, STOP_READ, Single
from readmill.plans.windows import chunks, windows


def plan(sequence, kind="back", rate=0.1, overlap=1, indels=True, aw=False, rw=False):
    return Single("x", kind, sequence, rate, overlap, indels, aw, rw)


def find(p, *reads):
    return [None if r[5] < 0 else tuple(r) for r in locate(np.array([list(r.encode()) for r in reads], np.uint8).reshape(len(reads), -1), p).tolist()]


def plain(p, read):
    """One read, one table of (cost, score, origin), as the rules say."""
    a = p.sequence[::-1] if p.reverse else p.sequence
    r = read[::-1] if p.reverse else read
    m, n, k, ends = len(a), len(r), int(p.rate * len(a)), p.free_ends
    first, last = 0 if ends & STOP_READ else max(0, n - m - k), n if ends & START_READ else min(n, m + k)
    column = []
    for i in range(m + 1):
        if ends & START_ADAPTER and ends & START_READ:
            column.append((min(i, first), 0, first - i))
        elif ends & START_ADAPTER:
            column.append((first, 0, min(first - i, 0)))
        elif ends & START_READ:
            column.append((i, -2 * i, max(first - i, 0)))
        else:
            column.append((max(i, first), -2 * i, 0))
    best = None

    def offer(i, j):
        nonlocal best
        cost, score, origin = column[i]
        length, start = i + min(origin, 0), max(0, -origin)
        named = length - (a[start:i].count("N") if p.adapter_wildcards else 0)
        if length < p.min_overlap or cost > named * p.rate:
            return False
        if best is None or score > best[4] and (origin <= best[6] + m // 2 or length > best[7]):
            best = (start, i, max(0, origin), j, score, cost, origin, length)
            return True
        return False

    for j in range(first + 1, last + 1):
        c, s, o = column[0]
        new = [(c, s, o + 1) if ends & START_READ else (c + 1, s - 2, o)]
        for i in range(1, m + 1):
            (dc, ds, do), (ic, is_, io), (lc, ls, lo) = column[i - 1], column[i], new[i - 1]
            if equal(a[i - 1], r[j - 1], p.adapter_wildcards, p.read_wildcards):
                new.append((dc, ds + 1, do))
            elif dc + 1 <= lc + 1 and dc + 1 <= ic + 1:
                new.append((dc + 1, ds - 1, do))
            elif lc <= ic:
                new.append((lc + 1, ls - 2, lo))
            else:
                new.append((ic + 1, is_ - 2, io))
        column = new
        if ends & STOP_READ and offer(m, j) and column[m][0] == 0 and column[m][2] >= 0:
            break
    else:
        if last == n:
            for i in range(m, -1 if ends & STOP_ADAPTER else m - 1, -1):
                offer(i, n)
    if best is None:
        return None
    a0, a1, r0, r1, score, cost = best[:6]
    return (m - a1, m - a0, n - r1, n - r0, score, cost) if p.reverse else (a0, a1, r0, r1, score, cost)


@pytest.mark.parametrize(
    "sequence, kind, rate, read, want",
    [
        ("CCAGTCCTCT", "prefix", 0.3, "CCAGTCCTTTCCTGAGAGT", (0, 10, 0, 10, 8, 1)), ("TCGATC", "prefix", 0.25, "TCGATGC", (0, 6, 0, 6, 4, 1)), ("TTTT", "back", 0.25, "CCTTTT", (0, 4, 2, 6, 4, 0)),
        ("GCCGAACTTCTTAGACTGCCTTAAGGACGT", "back", 0.1, "CAAATCACCAGAAGGCGCCTAACTTCTTAGACTGCC", (0, 20, 16, 36, 18, 1)), ("CTGATCTGGCCG", "back", 0.1, "AAAAGGG", None),
    ],
)
def test_known(sequence, kind, rate, read, want):
    assert find(plan(sequence, kind, rate), read) == [want] == [plain(plan(sequence, kind, rate), read)]


@settings(max_examples=300, deadline=None)
@given(st.text("ACGT", min_size=3, max_size=12), st.lists(st.text("ACGTN", min_size=14, max_size=14), min_size=1, max_size=6), st.sampled_from(sorted(KINDS)), st.sampled_from([0.0, 0.1, 0.2, 0.34]), st.booleans(), st.integers(0, 2))
def test_same_as_plain(sequence, reads, kind, rate, wild, where):
    if wild:
        sequence = sequence[:-1] + "N"
    reads = [r[: 7 - where] + sequence[: len(sequence) - where] + r for r in reads]
    reads = [r[: min(map(len, reads))] for r in reads]
    p = plan(sequence, kind, rate, overlap=len(sequence) if kind in ("prefix", "suffix") else 2, aw=wild, rw=where == 1)
    assert find(p, *reads) == [plain(p, r) for r in reads]


def test_hamming_comparers():
    assert find(plan("ACGTAC", "prefix", 0.34, indels=False), "ACGTTCGGG", "AGGGTCGGG") == [(0, 6, 0, 6, 4, 1), None]
    assert find(plan("ACGTAC", "suffix", 0.34, indels=False), "GGGACCTAC", "GGGTTTTAC") == [(0, 6, 3, 9, 4, 1), None]


def test_chunks_and_windows():
    assert chunks("ABCDE", 2) == {"ABC", "DE"}
    assert windows(plan("TTAGACATATCTCCGTCG", overlap=3)) == {(-3, None): {"TTA"}, (-4, None): {"TTAG"}, (-18, None): {"CATAT", "TTAGA"}, (0, None): {"TTAGACATA", "TCTCCGTCG"}}
    assert windows(plan("ADAPTER")) is None and windows(plan("ACGT", "prefix", indels=False)) is None


def test_windows_never_lose_matches_without_indels():
    random.seed(2)
    import re

    from readmill.plans.windows import pattern

    for _ in range(300):
        p = plan("".join(random.choices("ACGT", k=random.randrange(4, 14))), random.choice(["front", "back", "anywhere", "noninternal_front", "noninternal_back"]), random.choice([0.1, 0.2]), 3, indels=False)
        read = "".join(random.choices("ACGT", k=10)) + p.sequence[: random.randrange(3, 14)] + "".join(random.choices("ACGT", k=random.randrange(0, 6)))
        hit = any(re.search(pattern(k, p), read[max(0, len(read) + a) if a < 0 else a : b]) for (a, b), k in windows(p).items())
        assert hit or plain(p, read) is None or plain(p, read)[5] > 0 and not p.indels


@settings(max_examples=150, deadline=None)
@given(st.text("ACGTN", min_size=3, max_size=11), st.lists(st.text("ACGTN", max_size=30), min_size=1, max_size=8), st.sampled_from(sorted(KINDS)), st.sampled_from([0.0, 0.15, 0.34]), st.booleans(), st.booleans())
def test_reads_of_different_lengths(sequence, reads, kind, rate, wild, indels):
    from readmill.functions.letters import Letters
    from readmill.operators.align import locate_columns

    import pyarrow as pa

    reads = [r[: k * 3] + sequence[k % 3 :] + r[k * 3 :] if k % 2 else r for k, r in enumerate(reads)]
    p = plan(sequence, kind, rate, overlap=len(sequence) if kind in ("prefix", "suffix") else 2, aw=wild, indels=indels or kind in ("prefix", "suffix"))
    held = Letters(pa.array(reads))
    got = locate_columns(held.columns(held.start, held.length, p.reverse), held.length, p)
    if p.indels:
        assert [None if r[5] < 0 else tuple(r) for r in got.tolist()] == [plain(p, r) for r in reads]


def mutated(rnd, a, errors):
    for _ in range(errors):
        k = rnd.randrange(len(a))
        a = a[:k] + rnd.choice(["", rnd.choice("ACGT"), a[k] + rnd.choice("ACGT")]) + a[k + 1 :]
    return a


@pytest.mark.parametrize("kind", ["back", "rightmost_front"])
@pytest.mark.parametrize("rate, indels", [(0.0, True), (0.1, True), (0.2, True), (0.34, True), (0.2, False)])
def test_columns_left_out_change_nothing(kind, rate, indels):
    """Several near and exact copies in one read, reads of many lengths: with and without the costs that come first."""
    from readmill.operators import align

    import pyarrow as pa
    from readmill.functions.letters import Letters

    rnd = random.Random(f"{kind}{rate}{indels}")
    for m in (3, 6, 13, 20, 33, 64):
        a = "".join(rnd.choices("ACGT", k=m))
        p = plan(a, kind, rate, overlap=rnd.choice([1, 3]), indels=indels)
        reads = []
        for _ in range(60):
            parts = ["".join(rnd.choices("ACGTN" if rnd.random() < 0.3 else "ACGT", k=rnd.randrange(0, 25)))]
            for _ in range(rnd.randrange(0, 4)):
                parts += [mutated(rnd, a, rnd.choice([0, 0, 1, 2, 3])), "".join(rnd.choices("ACGT", k=rnd.randrange(0, 25)))]
            read = "".join(parts)
            reads.append(read[: rnd.randrange(0, len(read) + 1)] if rnd.random() < 0.3 else read)
        held = Letters(pa.array(reads))
        letters, length = held.columns(held.start, held.length, p.reverse), held.length.astype(np.int64)
        bits, places = align.letter_bits(p)
        slow = align._located(bits[letters], places, length, p, None, None)
        assert align.locate_columns(letters, length, p).tolist() == slow.tolist()
        if indels:
            assert [None if r[5] < 0 else tuple(r) for r in slow.tolist()] == [plain(p, r) for r in reads]


def test_pairs_with_adapters_of_their_own():
    from readmill.operators import align

    rnd = random.Random(5)
    for kind in sorted(KINDS):
        m = rnd.randrange(5, 15)
        plans = [plan("".join(rnd.choices("ACGT", k=m)), kind, 0.2, overlap=m if kind in ("prefix", "suffix") else 3) for _ in range(9)]
        which = np.array([rnd.randrange(9) for _ in range(200)])
        reads = ["".join(rnd.choices("ACGTN", k=rnd.randrange(0, 12))) + mutated(rnd, plans[k].sequence, rnd.randrange(3)) + "".join(rnd.choices("ACGT", k=rnd.randrange(0, 12))) for k in which]
        turned = [r[::-1] for r in reads] if plans[0].reverse else reads
        codes = np.full((max(map(len, reads)), len(reads)), 4, np.uint8)
        for k, r in enumerate(turned):
            codes[: len(r), k] = ["ACGTN".index(c) for c in r]
        got = align.locate_pairs(codes, np.array([len(r) for r in reads]), plans, which)
        assert [None if r[5] < 0 else tuple(r) for r in got.tolist()] == [plain(plans[k], r) for k, r in zip(which, reads)], kind


@pytest.mark.parametrize("kind", ["back", "front", "rightmost_front", "rightmost_back"])
def test_adapters_anywhere_are_looked_for_at_both_ends(kind):
    """A read that only overlaps with the other end of such an adapter, or lies within it, is aligned as well."""
    from readmill.operators import trim
    from readmill.plans.spec import BACK, FRONT, Search, adapter

    import pyarrow as pa

    side, text = {"back": (BACK, "{};anywhere"), "front": (FRONT, "{};anywhere"), "rightmost_front": (FRONT, "{};rightmost;anywhere"), "rightmost_back": (BACK, "{};rightmost;anywhere")}[kind]
    sequence = "AGATCGGAAGAGC"
    reads = [sequence[-n:] + "T" * 30 for n in (3, 4, 6, 9)] + ["T" * 30 + sequence[:n] for n in (3, 4, 6, 9)] + [sequence[3:9], "T" * 30]
    for prefilter in (True, False):
        p = adapter(text.format(sequence), side, Search(max_errors=0.2, prefilter=prefilter))
        got = [[m["errors"] for m in x] for x in trim._Search([p], 1)(pa.array(reads)).to_pylist()]
        assert p.force_anywhere and got[:8] == [[0]] * 8 and got[9] == [], prefilter
    assert got[8] == [0]


def test_the_query_aligns_every_read(spark):
    """A cell-by-cell search of all reads, whatever windows they have."""
    from readmill import queries as Q

    sf_dir = "/root/testdata/sf0.001"
    p = plan(Q.A3, rate=0.2, overlap=3)
    p = Single(**{**p.__dict__, "adapter_wildcards": True, "force_anywhere": True})
    reads = {r["name"]: r["sequence"] for r in Q.reads(spark, sf_dir).orderBy("name").limit(1500).collect()}
    got = {r["name"]: None if r["errors"] is None else (r["astart"], r["astop"], r["rstart"], r["rstop"], r["score"], r["errors"]) for r in Q.QUERIES["force_anywhere_dp"](spark, sf_dir).collect()}
    assert {n: got[n] for n in reads} == {n: plain(p, s) for n, s in reads.items()}
