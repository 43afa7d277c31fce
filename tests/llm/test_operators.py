"""The operators against plain versions, on larger and harder inputs than the edge cases."""

import hashlib
import random
import resource
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill.llm import bpe, html_extract, line_dedup, merkle, mixing, ngram_join, pieces, quality
from readmill.llm.common import word_hashes
from readmill.llm.queries import vocabulary

random.seed(11)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 9))) for _ in range(400)]
prose = lambda n: " ".join(random.choice(WORDS) for _ in range(n))


# --- HTML ---------------------------------------------------------------------------------------------------------------
def sentences(n, first=0):
    return " ".join(f"Sentence {k} has some plain words in it, and more." for k in range(first, first + n))


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<font>x<br>" * 100_000, "<b><div>" + "<i>" * 50_000 + "x</b>" * 50_000, "<p>" * 100_000 + "y", "<form>" * 50_000 + "z"])
def test_open_elements_cost_linear_time(page):
    began = time.perf_counter()
    assert html_extract.main_text(page)
    assert time.perf_counter() - began < 4


def test_page_in_one_form():
    page = f"<html><body><form id=aspnetForm><input type=hidden><div id=menu><a href=/>x</a></div><div><p>{sentences(6)}</p><p>{sentences(5, 6)}</p></div></form><footer>f</footer>"
    assert html_extract.main_text(page) == sentences(11)
    small = f"<html><body><div id=c><p>{sentences(6)}</p><form><label>Your name and address, please, and a long hint</label></form></div>"
    assert html_extract.main_text(small) == sentences(6)


def test_articles_beside_each_other():
    page = f"<body><nav><a>x</a></nav><main><article><h1>A</h1><p>{sentences(3)}</p><p>{sentences(4)}</p></article><article><h1>B</h1><p>{sentences(30)}</p><p>{sentences(30)}</p></article></main>"
    assert html_extract.main_text(page) == f"A {sentences(3)} {sentences(4)} B {sentences(30)} {sentences(30)}"


def test_names_that_may_be_sections():
    page = f"<body><article><h1>T</h1><p>{sentences(4)}</p><section class=related-work><h2>Before</h2><p>{sentences(6)}</p></section><section class='related-posts'><p>Teaser one of some length to read</p></section><section id=legal><p>{sentences(9)}</p></section></article>"
    assert html_extract.main_text(page) == f"T {sentences(4)} Before {sentences(6)} {sentences(9)}"


def test_links_inside_the_content():
    page = f"<body><div id=c><h1>T</h1><p>{sentences(4)}</p><ul><li><a href=1>First link</a></li><li><a href=2>Second link</a></li></ul><p>{sentences(6)}</p></div><ul><li><a href=/>Elsewhere</a></li></ul>"
    assert html_extract.main_text(page) == f"T {sentences(4)} First link Second link {sentences(6)}"


# --- texts without white space ---------------------------------------------------------------------------------------------
_BIG = """
import resource, sys
from readmill.llm import bpe, pieces
from readmill.llm.common import word_hashes
from readmill.llm.queries import vocabulary
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = ("\\u6f22\\u5b57\\u3068\\u4eee\\u540d\\u306e\\u6587\\u7ae0\\u3002" * 1_900_000).encode()
assert len(text) > 50_000_000 and len(word_hashes(text)) == 1
coder = pieces.Coder(vocabulary())
assert len(coder.ids(text)) % (1_900_000 * 2) == 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_fifty_megabytes_without_white_space():
    """A worker stays within 700 MB for a text of 51 MB (its characters, its ids and the stretch at work)."""
    out = subprocess.run([sys.executable, "-c", _BIG], capture_output=True, text=True, timeout=600, env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 700


def test_long_words_hash_like_short_ones():
    word, text = b"abc" * 400_000, b" tail of words"
    whole = word_hashes(word + text)
    assert len(whole) == 4 and whole[1:].tolist() == word_hashes(text).tolist()
    assert word_hashes(word)[0] == whole[0] == word_hashes(b"x " + word)[1] and word_hashes(word[:-1])[0] != whole[0]


def test_coders_agree_with_the_library_on_pieces():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    coder, own = pieces.Coder(vocabulary()), bpe.Bpe(vocabulary())
    pool = ["Word", "don't", "İstanbul", "été!!", "x1y2", "a<b", "<|endoftext|>", "$$$", "12.5%", "ßª", "漢字。", "naïve,", "o'", "'s", "café́", " ", "A" * 100, "it's...", "ǅx", "ﬁx"]
    for _ in range(400):
        text = "".join(random.choice(pool) + random.choice(["", "", " ", "\n"]) for _ in range(random.randrange(1, 8)))
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.ids(text.encode()), "u2").tolist() == want and np.frombuffer(own.encode(text.encode()), "<u4").tolist() == want, text


# --- line dedup -----------------------------------------------------------------------------------------------------------
def plain_runs(docs, i):
    """How many maximal runs of document i are later copies, and the lines of the longest; documents by ascending id."""
    worded = {k: [x for x in t.split("\n") if x.split()] for k, t in docs.items()}
    first = {}
    for k in sorted(docs):
        for a in range(len(worded[k])):
            for t in range(12):
                if a + 2**t <= len(worded[k]):
                    first.setdefault(tuple(worded[k][a : a + 2**t]), (k, a))
    runs, last = [], None
    shifted = {}
    for a in range(len(worded[i])):
        copies = [(2**t, first[tuple(worded[i][a : a + 2**t])]) for t in range(12) if a + 2**t <= len(worded[i])]
        copies = [(n, of) for n, of in copies if of != (i, a)]
        if copies:
            shifted.setdefault((copies[-1][1][0], a - copies[-1][1][1]), []).append((a, copies[-1][0]))
    for places in shifted.values():
        for a, n in places:
            if last is not None and runs and runs[-1][2] is places and a == last + 1:
                runs[-1][1] = max(runs[-1][1], a + n)
            else:
                runs.append([a, a + n, places])
            last = a
    return len(runs), max((b - a for a, b, _ in runs), default=0)


def test_line_dedup_against_plain(spark):
    pool = [prose(random.randrange(1, 6)) for _ in range(60)]
    block = [prose(4) for _ in range(9)]
    docs = {}
    for i in range(80):
        lines = [random.choice(pool) if random.random() < 0.3 else prose(7) for _ in range(random.randrange(0, 12))]
        if i % 7 == 3:
            lines[2:2] = block[: random.randrange(3, 9)]
        if i % 5 == 0:
            lines.insert(0, "  ")
        docs[i] = "\n".join(lines)
    seen, want = set(), {}
    for i, text in docs.items():
        kept, n, removed = [], 0, 0
        for line in text.split("\n"):
            if not line.split():
                kept.append(line)
                continue
            n += 1
            if line in seen:
                removed += 1
            else:
                seen.add(line)
                kept.append(line)
        want[i] = (n, removed, *plain_runs(docs, i), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["longest_run"], r["kept_sha256"]) for r in line_dedup.report(df).collect()} == want
    assert max(w[3] for w in want.values()) >= 5 and max(w[2] for w in want.values()) > 1


def test_maximal_runs(spark):
    a, b = [f"line {k} of a" for k in range(6)], [f"line {k} of b" for k in range(5)]
    docs = [(0, a), (1, ["x"] + a[1:5] + ["y"] + b), (2, b[1:4] + a[:2] + ["z"]), (3, b[2:3])]
    levels = line_dedup.repeats(line_dedup.lines_of(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")))
    found = {(r["doc"], r["start"], r["lines"], r["source"]["doc"], r["source"]["line"]) for r in line_dedup.runs(levels).collect()}
    assert found == {(1, 1, 4, 0, 1), (2, 0, 3, 1, 7), (2, 3, 2, 0, 0), (3, 0, 1, 1, 8)}
    gone = lambda n: {(r["doc"], r["line"]) for r in line_dedup.repeated(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string"), n, 1)[0].collect()}
    assert gone(3) == {(1, k) for k in range(1, 5)} | {(2, k) for k in range(3)} and gone(4) == {(1, k) for k in range(1, 5)}


# --- near duplicates --------------------------------------------------------------------------------------------------------
def test_chance_bands_tie_nothing(spark):
    """Texts of a similarity near 0.4 share bands by the dozen; nominated ties stay few, and no class forms."""
    shared = prose(60).split()
    rows = []
    for k in range(300):
        own = [f"{w}{k}" for w in prose(40).split()]
        rows.append((k, " ".join(shared + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df).collect()
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got)
    bands, per = ngram_join.bands_for(0.8, 0.99999)
    values = [ngram_join.signature(ngram_join.grams(t.encode(), 5), bands, per) for _, t in rows]
    keys = [set(ngram_join.band_keys(v)) for v in values]
    by_chance = sum(bool(keys[i] & keys[j]) for i in range(300) for j in range(i))
    tied = ngram_join.forest(np.array([v.astype(np.uint8).ravel() for v in values]), ngram_join.enough(0.8, bands * per))
    assert by_chance > 5_000 and len(tied) < 30


def test_equal_rows_leave_one(spark):
    text = prose(80)
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, prose(50), "c"), (3, prose(50), "c")], "doc_id long, text string, _kept string")
    left = sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect())
    assert left == [1, 3, 3]


# --- mixing -----------------------------------------------------------------------------------------------------------------
def test_mixing_agrees_whatever_the_order_of_rows(spark):
    rows = [(1, f"row {k} x", "a") for k in range(400)] + [(None, f"none {k}", "a") for k in range(100)] + [(2, prose(900), "b")]
    key = lambda df: Counter((r["doc_id"], r["row"], r["taken"]) for r in mixing.mix(df).collect())
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string")
    first = key(make(rows))
    random.shuffle(rows)
    assert key(make(rows).repartition(5)) == first


def test_mixed_keeps_columns_like_its_own(spark):
    df = spark.createDataFrame([(k, prose(20), "s", 1, 2, 3) for k in range(30)], "doc_id long, text string, source string, _rows int, _rowk int, taken int")
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() > 30


# --- quality ----------------------------------------------------------------------------------------------------------------
def test_posterior_and_kept_against_plain(spark):
    junk = ["#### $$$$ %%%% &&&& " * 12, "BUY NOW!! " * 30, "la la la la " * 40]
    rows = [(k, ". ".join(prose(12).capitalize() for _ in range(8)) + ".") for k in range(60)] + [(100 + k, junk[k % 3] + prose(25)) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    votes = {i: quality.measures(t.encode())[1] for i, t in rows}
    assert {i: r["votes"] for i, r in got.items()} == votes
    # expectation-maximisation by loops over documents and rules
    n, rules = len(rows), range(len(quality.RULES))
    belief = [[p * (10 + 0.02 * n) for p in row] for row in ([0.3, 0.6, 0.1], [0.02, 0.38, 0.6])]
    prior, table = 0.8, [[[b / sum(belief[c]) for b in belief[c]] for c in (0, 1)] for _ in rules]

    def good(v):
        like = [1 - prior, prior]
        for r in rules:
            like = [like[c] * table[r][c]["-0+".index(v[r])] for c in (0, 1)]
        return like[1] / sum(like)

    for _ in range(200):
        share = {i: good(v) for i, v in votes.items()}
        before, prior = prior, (sum(share.values()) + 8) / (n + 10)
        for r in rules:
            for c in (0, 1):
                new = [belief[c][k] + sum(s if c else 1 - s for i, s in share.items() if votes[i][r] == "-0+"[k]) for k in range(3)]
                table[r][c] = [x / sum(new) for x in new]
        if abs(before - prior) < 1e-9:
            break
    for i, r in got.items():
        assert r["posterior"] == pytest.approx(good(votes[i]), abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert not any(got[100 + k]["kept"] for k in range(15)) and all(got[k]["kept"] for k in range(60))


# --- fingerprints -----------------------------------------------------------------------------------------------------------
def test_differences_of_trees(spark):
    base = "\n".join(f"Paragraph {k} begins, goes on; and ends {k}." for k in range(300))
    lines = base.split("\n")
    cases = {
        "same": base, "changed": base.replace("and ends 150", "and stops 150"), "clause gone": base.replace(" goes on;", "", 1).replace("x", "x"), "line gone": "\n".join(lines[:40] + lines[41:]),
        "added": "\n".join(lines[:7] + ["A new line, here."] + lines[7:]), "moved": "\n".join(lines[1:] + lines[:1]),
    }
    df = spark.createDataFrame([(k, base, t) for k, t in cases.items()], "case string, a string, b string")
    out = df.select("case", merkle.differences(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d"), (merkle.tree(F.col("a"))["root"] == F.substring_index(merkle.fingerprint(F.col("a")), ":", 1)).alias("rooted"))
    got = {r["case"]: (r["d"]["removed"], r["d"]["added"], r["d"]["moved"]) for r in out.collect()}
    leaf = lambda t: [x for p in t.split("\n") for x in __import__("re").findall(r"[^.!?,;:|]{1,48}[.!?,;:|]*|[.!?,;:|]+", p)]
    want = {}
    for k, t in cases.items():
        x, y = leaf(base), leaf(t)
        removed, added = [i for i, v in enumerate(x) if v not in set(y)], [i for i, v in enumerate(y) if v not in set(x)]
        want[k] = (removed, added, t != base and not removed and not added)
    assert got["same"] == ([], [], False) and got["changed"] == want["changed"] and got["line gone"] == want["line gone"] and got["added"] == want["added"] and got["moved"][2]
    assert got["clause gone"][1] == want["clause gone"][1] and all(r["rooted"] for r in out.collect())
