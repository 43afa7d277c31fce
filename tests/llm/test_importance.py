"""Importance resampling against a plain version, with nulls, ties, long texts and runs of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from readmill.llm import importance

random.seed(11)
SCHEMA = "doc_id long, text string, rank string, weight int, place int"
pick = lambda words, n: " ".join(random.choice(words) for _ in range(n))
NEAR, FAR = ["Target", "WORDS", "like", "these", "été", "x-y"], ["other", "things", "ΣΑΣ", "12345", "日本語", "under_score"]
ROWS = [(k, pick(NEAR if k % 5 == 0 else FAR, random.randrange(0, 80)), "clash", 1, 2) for k in range(400)]
ROWS += [(None, pick(FAR, 30), "", 0, 0), (None, None, "", 0, 0), (None, pick(FAR, 30), "", 0, 0), (5000, "", "", 0, 0), (5001, " \t\n-- !!", "", 0, 0), (5002, pick(FAR, 200_000), "", 0, 0)]
ROWS += [(7, ROWS[7][1], "", 0, 0), (8, pick(NEAR, 25), "", 0, 0)]
TARGET = [(k, pick(NEAR, 30)) for k in range(40)] + [(None, None)]


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest=1, least=20):
    found = [(i, *features(t, longest)) for i, t, *_ in rows]
    s, t = Counter(x for _, _, f in found for x in f), Counter(x for _, text in target for x in features(text, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(order[: len(order) * 10 // 100]):
        x[4] = k + 1
    return sorted(map(repr, (tuple(x[:5]) for x in out)))


@pytest.mark.parametrize("longest", [1, 3])
def test_same_as_plain(spark, longest):
    docs, target = spark.createDataFrame(ROWS, SCHEMA).repartition(5), spark.createDataFrame(TARGET, "item_id long, text string")
    out = importance.resample(docs, target, longest=longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == plain(ROWS, TARGET, longest)
    drawn = [r for r in got if r[4] is not None]
    assert drawn and sum(r[0] is not None and (r[0] % 5 == 0 or r[0] == 8) for r in drawn) > 0.9 * len(drawn)  # texts like the target's


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ROWS[:30], SCHEMA)
    assert importance.resample(none, some).collect() == []
    assert sorted(map(repr, map(tuple, importance.resample(some, none).collect()))) == plain(ROWS[:30], [])


def test_ties_go_to_smaller_ids(spark):
    """Rows of one id have one Gumbel number, so equal texts among them tie."""
    rows = [(1, "a " * 25, "", 0, 0)] * 15 + [(None, "a " * 25, "", 0, 0)] * 15
    got = [tuple(r) for r in importance.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TARGET, "item_id long, text string")).collect()]
    assert sorted(map(repr, got)) == plain(rows, TARGET) and sum(r[4] is not None for r in got) == 3


@pytest.mark.parametrize("text", ["ab cd " * 40, "x" * 300 + " yz", "one", "a " + "é" * 60 + "-b c", " " * 50 + "w"])
def test_pieces_cut_no_word(monkeypatch, text):
    whole = [x.tolist() if hasattr(x, "tolist") else x for x in importance.buckets_of(text.encode(), 3, 10_000)]
    monkeypatch.setattr(importance, "PIECE", 7)
    buckets, n = importance.buckets_of(text.encode(), 3, 10_000)
    assert n == whole[1] == features(text, 1)[0] and sorted(buckets.tolist()) == sorted(whole[0]) == sorted(features(text, 3)[1])
