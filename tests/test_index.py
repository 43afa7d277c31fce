"""Many adapters through the index against a search for each of them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readmill.operators import index, trim
from readmill.operators.trim import edit_neighbours
from readmill.plans.spec import ANYWHERE, BACK, FRONT, Search, adapters


def mutated(rnd, a, errors):
    for _ in range(errors):
        k = rnd.randrange(len(a))
        a = a[:k] + rnd.choice(["", rnd.choice("ACGT"), a[k] + rnd.choice("ACGT")]) + a[k + 1 :]
    return a


def reads_with(rnd, codes, n):
    out = ["", "A", "N" * 20, "ACGT" * 10, None]
    for _ in range(n):
        text = lambda most: "".join(rnd.choices("ACGTNacgtuR" if rnd.random() < 0.2 else "ACGT", k=rnd.randrange(most)))
        read = mutated(rnd, rnd.choice(codes), rnd.choice([0, 0, 1, 1, 2, 3]))
        read = {0: read + text(40), 1: text(40) + read, 2: text(20) + read + text(20)}[rnd.randrange(3)]
        out.append(read[: rnd.randrange(1, len(read) + 1)] if read and rnd.random() < 0.2 else read)
    return out


SPECS = {
    "prefix": (FRONT, "^{}"), "suffix": (BACK, "{}$"), "front": (FRONT, "{}"), "back": (BACK, "{}"), "anywhere": (ANYWHERE, "{}"), "noninternal_front": (FRONT, "X{}"), "noninternal_back": (BACK, "{}X"),
    "rightmost_front": (FRONT, "{};rightmost"), "rightmost_back": (BACK, "{};rightmost"), "force_anywhere": (BACK, "{};anywhere"),
}


@pytest.mark.parametrize("kind", [*SPECS, "all"])
@pytest.mark.parametrize("rate", [0.0, 0.1, 0.26])
@pytest.mark.parametrize("how", [{}, {"adapter_wildcards": False}, {"indels": False}])
def test_same_as_each_search(monkeypatch, kind, rate, how):
    rnd = random.Random(f"{kind}{rate}{how}")
    codes = ["".join(rnd.choices("ACGT", k=m)) for m in (4, 6, 6, 8, 8, 8, 12, 12, 14, 33) for _ in range(3)] + ["ACACAC", "ACACAC", "AAAAAA"]
    sides = [SPECS[kind if kind != "all" else rnd.choice(list(SPECS))] for _ in codes]
    plans = adapters([(side, f"n{k}=" + text.format(c)) for k, (c, (side, text)) in enumerate(zip(codes, sides))] + [(BACK, "odd=ACNNGT"), (FRONT, "linked=ACGTA...TTGCA")], Search(max_errors=rate, **how))
    reads = pa.array(reads_with(rnd, codes, 400), pa.string())
    for times in (1, 2):
        fast = trim._Search(plans, times)
        assert fast.index is not None or not how.get("indels", True)
        monkeypatch.setattr(trim, "MANY", 10**9)
        slow = trim._Search(plans, times)
        monkeypatch.undo()
        assert slow.index is None
        got, want = fast(reads).to_pylist(), slow(reads).to_pylist()
        assert got == want and sum(map(bool, want)) > 20


def test_left_out_letters_find_all_within_k_edits():
    rnd = random.Random(3)
    for k in (0, 1, 2):
        codes = ["".join(rnd.choices("ACGT", k=7)) for _ in range(5)]
        found = index.LeftOut(codes, k)
        for a, code in enumerate(codes):
            near = sorted(edit_neighbours(code, k))
            reads = np.full((9 + 4, len(near)), 4, np.uint8)
            for j, s in enumerate(near):
                s = (s + "".join(rnd.choices("ACGT", k=13)))[:13]
                reads[:, j] = index.letters(s)
            r, c = found.nominate(reads, np.full(len(near), 13))
            assert set(range(len(near))) <= set(r[c == a].tolist())


def test_pieces_longer_than_what_is_marked():
    plans = adapters([(BACK, "a=ACGTACGTTGCAACGT"), (BACK, "b=ACGTACGTTGCAACGA")], Search(max_errors=0))
    out = trim._Search(plans, 1)(pa.array(["TTACGTACGTTGCAACGATT", "TTACGTACGTTGCAACGTTT", "TTACGTACGTTGCAACGCTT", "CCCCACGTACG"])).to_pylist()
    assert [[m["adapter"] for m in x] for x in out] == [["b"], ["a"], [], ["a"]]


def test_index_join_with_indels_by_the_index(spark):
    rnd = random.Random(8)
    codes = ["".join(rnd.choices("ACGT", k=10)) for _ in range(60)]
    plans = adapters([(FRONT, f"b{k}=^{c}") for k, c in enumerate(codes)], Search(max_errors=0.1))
    rows = [(k, mutated(rnd, codes[k % 60], k % 3) + "ACGTTGCA") for k in range(900)]
    got = trim.index_join(spark.createDataFrame(rows, "id int, sequence string"), plans)
    one = {(r["id"], r["adapter"], r["errors"]) for r in got.collect()}
    each = set()
    for p in plans:
        found = trim.find_adapters(spark.createDataFrame(rows, "id int, sequence string"), [p]).where(F.size("matches") > 0)
        each |= {(r["id"], r["matches"][0]["adapter"], r["matches"][0]["errors"]) for r in found.collect()} if p.name in ("b0", "b1", "b2") else set()
    assert {x for x in one if x[1] in ("b0", "b1", "b2") and x[0] % 60 < 3} == {x for x in each if x[0] % 60 == int(x[1][1:])} and len(one) > 500
