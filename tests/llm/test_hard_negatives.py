"""Hard negatives against a plain version: ties, repeated vectors, odd components, many blocks; and bounds that discard without losing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score int"
rng = np.random.default_rng(3)


def table(n, width, labels=4, copies=0):
    centres = rng.normal(size=(labels * 3, width))
    x = (centres[rng.integers(0, len(centres), n)] + 0.7 * rng.normal(size=(n, width))) / math.sqrt(width)
    x[:copies] = x[0]  # one vector of many rows
    return [(int(k), [float(v) for v in row], int(rng.integers(0, labels)), "", 0) for k, row in enumerate(x)]


def plain(rows, every=100, positives=5, negatives=5, percent=80):
    kept = [(i, [min(max(math.floor(np.float32(x).item() * 256), -H.MOST), H.MOST) for x in v], l) for i, v, l, *_ in rows if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    ids, label = np.array([k[0] for k in kept]), np.array([k[2] for k in kept])
    x = np.array([k[1] + [0] * (width - len(k[1])) for k in kept], np.int64).reshape(len(kept), width)
    out = []
    for a in np.flatnonzero(ids % every == 0) if len(kept) else []:
        score = x @ x[a]
        best = lambda at, n: sorted(at, key=lambda j: (-score[j], ids[j]))[:n]  # noqa: B023, E731
        for p in best([j for j in np.flatnonzero(label == label[a]) if ids[j] != ids[a]], positives):
            fits = np.flatnonzero((label != label[a]) & (ids != ids[a]) & (100 * score <= 100 * score[p]) & (100 * score >= percent * score[p]))
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[j]), int(score[p]), int(score[j])) for k, j in enumerate(best(fits, negatives))]
    return sorted(out)


def mined(spark, rows, **how):
    out = H.mine(H.usable(spark.createDataFrame(rows, SCHEMA).repartition(3)), **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def test_odd_rows(spark):
    rows = table(600, 12, copies=150)
    rows += [(1000, None, 1, "", 0), (1100, [None] + [0.1] * 11, 1, "", 0), (1200, [math.nan] * 12, 2, "", 0), (1300, [math.inf] + [0.0] * 11, 2, "", 0), (1400, [0.1] * 12, None, "", 0), (None, [0.1] * 12, 1, "", 0)]
    rows += [(1500, [0.3] * 5, 1, "", 0), (1600, [], 2, "", 0), (1700, [1e30, -1e30] + [0.5] * 10, 0, "", 0), (1701, [1e30] * 12, 0, "", 0), (1702, [1e29] * 12, 3, "", 0), (-100, [0.2] * 12, 1, "", 0)]
    rows += [rows[200], rows[200], (200, [0.25] * 12, 3, "", 0)]  # an anchor three times, twice the same
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_many_blocks(spark):
    rows = table(5000, 24)
    got = mined(spark, rows, every=2, negatives=2, positives=2)
    assert got == plain(rows, every=2, negatives=2, positives=2) and len(got) > 3000


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    rows = table(50, 8)
    assert mined(spark, [r for r in rows if r[0] % 100]) == []  # no anchor
    assert mined(spark, [(r[0], r[1], r[0], "", 0) for r in rows]) == []  # no positive
    assert mined(spark, [(r[0], r[1], 1, "", 0) for r in rows]) == []  # no negative


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_bounds_hold_and_discard(spark, width):
    x = np.array([r[1] for r in table(3000, width)])
    x[:, : max(1, width // 8)] *= 4  # most of the products in few directions
    x = np.floor(256 * x @ np.linalg.qr(rng.normal(size=(width, width)))[0]).astype(np.int32)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    record = {"ids": np.arange(3000).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(), "vectors": x.tobytes(), "rotated": (x @ turn).astype(np.float32).tobytes()}
    cuts = H.stages(width)
    block = H.Vectors(record, width, cuts)
    exact = x.astype(np.int64) @ x.T.astype(np.int64)
    low = np.sort(exact, axis=0)[-20][None].astype(float)
    seen = np.zeros((3000, 3000), bool)
    for r, c, score in H.pairs(block, block, cuts, slice(0, 3000), np.ones((3000, 3000), bool), low, np.full((1, 3000), np.inf)):
        assert (exact[r, c] == score).all()
        seen[r, c] = True
    assert seen[exact >= low].all()  # nothing that belongs is discarded
    assert seen.mean() < 0.5


def test_lists():
    lists = H.Lists(4, 2)
    lists.add(np.array([0, 0, 0, 2]), np.array([5, 7, 5, 1]), np.array([9, 1, 3, 4]))
    lists.add(np.array([2, 2, 3]), np.array([1, 1, 8]), np.array([2, 3, 5]))
    assert list(zip(lists.key.tolist(), lists.score.tolist(), lists.id.tolist())) == [(0, 7, 1), (0, 5, 3), (2, 1, 2), (2, 1, 3), (3, 8, 5)]
    assert lists.least(np.full(4, -1)).tolist() == [5, -1, 1, -1]


def test_anchors_are_not_broadcast(spark):
    """Copies of anchors for all salts aren't a broadcast, which the driver would hold, and there are no more of them than blocks of rows ask for."""
    rows = table(600, 12)
    usable = H.usable(spark.createDataFrame(rows, SCHEMA))
    blocks, anchors = (H.packed(usable, 12, None, n) for n in (64, 200))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        met = H.met(blocks, anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]))
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == blocks.count() * anchors.count() == met.select("block", "a_block").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert H.salts_for(1, 500) == 1 and H.salts_for(176, 12) == 24 and H.salts_for(32_000, 12) == 1000 and H.salts_for(0, 12) == 1
