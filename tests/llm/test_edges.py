"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill.llm import bpe, html_extract, line_dedup, merkle, mixing, ngram_join, quality, substring_dedup, token_counts, token_stream
from readmill.llm.queries import vocabulary

random.seed(5)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(1, 9))) for _ in range(300)]
prose = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
PASSAGE, LONG = prose(60), prose(30_000)
BASE = prose(200).split()
ROWS = [
    (1, " ".join(BASE), "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t ", "b"), (5, "one two", None), (6, "one two", None), (7, " ".join(BASE), "a"), (7, " ".join(BASE), "a"),
    (8, " ".join(BASE[:190] + ["new"] + BASE[191:]), "b"), (9, prose(30) + "\n" + PASSAGE + "\n" + prose(10), ""), (10, prose(20) + "\n" + PASSAGE + "\n" + prose(5), "a"), (11, LONG, "a"),
    (12, "x" * 5000, "b"), (13, "It's <|endoftext|> Été ΣΣ 12345!! \U0001f600", "c"), (14, "same line\nother line\nsame line\nother line\n\nend", "c"), (None, prose(40), "a"), (15, "la " * 100, "c"),
    (16, "same line\nother line\nthird", "c"),
]
CLASHES = ["n_words", "votes", "part", "line", "row", "rank", "key", "anchors", "hash", "component", "size", "n", "a", "b", "_q_votes", "_l_lines", "_row", "_kept"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def unique(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts(clashing, empty):
    t = library()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in ROWS]
    got = token_counts.count_tokens(clashing, vocabulary(), limit=1000)
    assert unique(got.collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 1000) for w in want), key=str)
    assert token_counts.count_tokens(empty, vocabulary()).collect() == []


def test_bpe(clashing, empty):
    t = library()
    want = []
    for i, x, _ in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    assert unique([(r[0], r[1], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(clashing, vocabulary()).collect()], 0, 1, 2, 3) == sorted(want, key=str)
    assert bpe.encode(empty, vocabulary()).collect() == []


def test_pair_tree_merges_leftmost_lowest_first():
    t = library()
    b = bpe.Bpe(vocabulary())
    for _ in range(300):
        text = "".join(random.choice("aeinrst") for _ in range(random.randrange(1, 60)))
        assert list(b._plain(text)) == t.encode(text, add_special_tokens=False).ids


def test_token_stream(spark, docs, empty, tmp_path):
    t = library()
    shards = token_stream.write_stream(docs, vocabulary(), 2, f"file://{tmp_path}/s", length=64)
    got = token_stream.read_stream(shards).collect()
    at = 0
    want = []
    for i, x in sorted(((i, x or "") for i, x, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert unique(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    reader = token_stream.ShardReader(shards.orderBy("shard").first()["path"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and mask[: min(64, shards.orderBy("shard").first()["n_tokens"])].all()
    for k, form in enumerate(("{}", "file:{}", "file://{}")):  # a folder with and without its scheme
        again = token_stream.read_stream(token_stream.write_stream(docs, vocabulary(), 2, form.format(f"{tmp_path}/again-{k}"), length=64)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert token_stream.read_stream(token_stream.write_stream(empty, vocabulary(), 2, f"file://{tmp_path}/e")).collect() == []


def test_quality_base_counts(clashing, empty):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(clashing).collect()}
    want = set()
    for i, x, _ in ROWS:
        w = [v for v in __import__("re").findall(r"[^\x20\x09-\x0D]+", x or "")]
        lines = [v for v in (x or "").split("\n") if v.strip(" \t\n\x0b\x0c\r")]
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        again = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(8)}
        want.add((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    assert got == want
    assert quality.judge(empty).collect() == []
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and 15 not in {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(empty).collect() == []


def test_label_model_finds_the_bad_class():
    model = quality.fit({"000000+++": 900, "-000000--": 40, "0-00000-0": 30, "000-0000-": 30})
    odds = np.log(model.votes[:, 1]) - np.log(model.votes[:, 0])
    score = lambda votes: np.log(model.prior / (1 - model.prior)) + sum(odds[k, "-0+".index(v)] for k, v in enumerate(votes))
    assert score("000000+++") > 0 > max(score("-000000--"), score("0-00000-0"), score("000-0000-"))


def test_substring_dedup(clashing, empty):
    seen = {}
    order = lambda i: -1 if i is None else i
    split = lambda x: (x or "").encode().split()
    for i, x, _ in ROWS:
        w = split(x)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            seen[g] = min(seen.get(g, order(i)), order(i))
    want = []
    for i, x, _ in ROWS:
        w = split(x)
        gone = {k + j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < order(i) for j in range(13)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(v for k, v in enumerate(w) if k not in gone)).hexdigest()))
    for batches in (1, 3):
        assert unique(substring_dedup.dedup(clashing, batches=batches).collect(), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert substring_dedup.dedup(empty).collect() == []


def test_index_compaction_keeps_what_is_shared(spark):
    index = substring_dedup.Index(8, fan=2)
    for text in (LONG, PASSAGE, LONG[:3000], PASSAGE):
        index.add(spark.createDataFrame([(text,)], "text string"))
    index.add(spark.createDataFrame([(prose(500),)], "text string"), compact=True)
    assert len(index.runs) == 1
    a = lambda t: set(substring_dedup.anchors(t.encode(), 13, 6)[0].tolist())
    assert {r["anchor"] for r in index.shared().collect()} == a(PASSAGE) | a(LONG[:3000]) & a(LONG)


def test_line_dedup(clashing, empty):
    got = {r["doc_id"]: r for r in line_dedup.report(clashing).collect()}
    assert got[10]["n_removed"] == 1 and got[9]["n_removed"] == 0  # a line of over 50 words
    assert (got[14]["n_removed"], got[14]["longest_run"], got[14]["deepest"]) == (2, 2, 2)
    assert got[14]["kept_sha256"] == hashlib.sha256(b"same line\nother line\n\nend").hexdigest()
    assert got[16]["n_removed"] == 2 and got[16]["kept_sha256"] == hashlib.sha256(b"third").hexdigest()
    assert got[2]["n_lines"] == got[3]["n_lines"] == 0 and got[7]["n_removed"] == 1
    left = line_dedup.without_repeats(clashing)
    assert left.columns == clashing.columns and {7} & {r["doc_id"] for r in left.collect()} == set()
    assert line_dedup.report(empty).collect() == [] and line_dedup.without_repeats(empty).collect() == []


def test_short_lines_standing_alone(spark):
    rows = [(k, f"first of {k}\nShare this page\nlast of {k}\nok") for k in range(5)] + [(9, "ok\n\nok"), (10, "a b\nc\na b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["longest_run"], r["kept_sha256"]) for r in line_dedup.report(docs).collect()}
    want = {0: (0, 0, rows[0][1]), 9: (2, 1, ""), 10: (1, 1, "a b\nc")} | {k: (2, 1, f"first of {k}\nlast of {k}") for k in range(1, 5)}
    assert got == {k: (n, run, hashlib.sha256(t.encode()).hexdigest()) for k, (n, run, t) in want.items()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()} == {k: t for k, (_, _, t) in want.items() if k != 9}


def test_ngram_join(clashing, empty):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(clashing).collect()}
    assert got[1] == (1, 3) and got[8] == (1, 3) and got[7][0] == 1  # two rows of document 7, and document 8
    assert got[5] == (5, 1) and got[6] == (5, 1) and got[9] == (9, 0)
    assert got[2] == (2, 0) and got[3] == (3, 0) and got[None][0] is None
    left = [r["doc_id"] for r in ngram_join.one_of_each(clashing).collect()]
    assert 1 in left and not {6, 7, 8} & set(left) and None in left
    assert ngram_join.near_duplicates(empty).collect() == []


def test_ngram_join_of_rows_without_ids(spark):
    """Rows are linked by their texts, whatever their ids are."""
    base = [prose(60).split() for _ in range(3)]
    x, y, z = (" ".join(w) for w in base)
    rows = [(None, x), (None, x + " more"), (None, y), (7, y + " more"), (8, x), (9, z), (9, z + " more"), (9, prose(60)), (None, prose(60)), (None, z)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, hash string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["set_id"] or 0) for r in ngram_join.near_duplicates(docs).collect())
    want = [(0, 8, 2, 8), (0, 8, 2, 0), (8, 8, 2, 8), (0, 7, 1, 0), (7, 7, 1, 7), (9, 9, 2, 9), (9, 9, 2, 9), (0, 9, 2, 9), (9, 9, 0, 9), (0, 0, 0, 0)]
    assert got == sorted(want)
    left = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(docs).collect())
    keeps = min((z, z + " more"), key=lambda t: spark.sql("SELECT xxhash64(:t)", args={"t": t}).first()[0])
    assert left == sorted([(8, x), (7, y + " more"), (9, keeps), (9, rows[7][1]), (0, rows[8][1])])


def test_ngram_join_of_many_rows_without_ids(spark, monkeypatch):
    """A thousand rows without ids: near copies of one text and texts of their own, in bounded blocks."""
    monkeypatch.setattr(ngram_join, "BUCKET", 50)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 50)
    words = prose(80).split()
    copies = [" ".join(words[:k % 80] + [f"w{k}"] + words[k % 80 + 1 :]) for k in range(300)]
    alone = [prose(50) + f" {k}" for k in range(700)]
    docs = spark.createDataFrame([(None, t) for t in copies + alone], "doc_id long, text string")
    g = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in copies]
    want = sorted([sum(a is not b and len(a & b) >= 0.8 * len(a | b) for b in g) for a in g] + [0] * 700)
    assert sorted(r["n_links"] for r in ngram_join.near_duplicates(docs).collect()) == want and want[-300] > 0
    left = [r["text"] for r in ngram_join.one_of_each(docs).collect()]
    assert len(left) == 701 and set(alone) <= set(left)


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of near copies over many blocks: every pair counts once."""
    words = prose(120).split()
    texts = [" ".join(words[:k] + [f"w{k}"] + words[k + 1 :]) for k in range(0, 120, 2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    g = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {k: sum(k != j and len(g[k] & g[j]) >= 0.8 * len(g[k] | g[j]) for j in range(len(g))) for k in range(len(g))}
    for block in (400_000, 1_000):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.near_duplicates(docs).collect()
        assert {r["doc_id"]: r["n_links"] for r in got} == want and {r["class_id"] for r in got} == {0}


def test_mixing(clashing, empty):
    got = mixing.mix(clashing).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert set(by) == {"", "a", "b", "c", None}
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.01 * total
    assert mixing.mix(empty).collect() == []
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and mixing.mixed(empty).collect() == []


def test_mixing_small_sources_reach_their_targets(spark):
    rows = [(100 * k + j, f"big {k} {j}", f"s{k:02}", 250_000) for k in range(20) for j in range(5)] + [(9000 + k, f"small {k}", f"s{k:02}x", 150) for k in range(0, 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w long")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs, size=F.col("w")).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert {s: t for s, t in target.items() if s.endswith("x")} == {f"s{k:02}x": 300 for k in range(0, 20, 2)}
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    assert sorted(r["doc_id"] for r in mixing.mixed(docs, size=F.col("w")).collect() if r["doc_id"] >= 9000) == sorted(2 * [9000 + k for k in range(0, 20, 2)])


def test_merkle(clashing, empty):
    got = merkle.edited_neighbours(clashing).collect()
    assert len(got) == len(ROWS)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[7] != prints[8] and prints[2] == prints[3] and prints[5] == prints[6]
    by = {r["doc_id"]: r for r in got}
    assert by[5]["near_next"] == 1.0 and by[11]["near_edited"] > 0.4
    t, n = dict((i, x or "") for i, x, _ in ROWS), len
    edited = t[9][: n(t[9]) - n(t[9]) // 2] + t[10][: n(t[9]) // 2]
    assert by[9]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert by[16]["edited_sha256"] == hashlib.sha256((t[16][: n(t[16]) - n(t[16]) // 2] + t[None][: n(t[16]) // 2]).encode()).hexdigest()
    assert merkle.edited_neighbours(empty).collect() == []


def test_edits_locate_the_changed_leaves(spark):
    a, b = "One two. Three four.\nFive six.", "One two. Three FOUR.\nFive six."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("at")).first()
    assert row["at"] == [1]


PAGE = """<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1><nav>a b</nav></header><div class="cookie-notice">We use cookies &amp; more</div><div id="content"><div class="post-header">
<h1>Title here</h1></div><p>First &eacute; paragraph is long enough to count as text, surely so.</p><p>Short.</p><p>Second paragraph&nbsp;with <b>bo</b>ld text that is long enough to be content of the page.</p>
<div class="share">Share this</div><p>Third paragraph, again long enough to be content of the page here.</p></div><aside><p>Sidebar text that is quite long, with many words in it too, to fool you.</p></aside>
<section id="comments"><p>Great article, I loved it so much, thank you for the long text of it.</p></section><form><label>Name</label></form><script>var x = "</p>";</script><footer>(c)</footer></body></html>"""


def test_html(spark):
    want = "Title here First é paragraph is long enough to count as text, surely so. Short. Second paragraph with bold text that is long enough to be content of the page. Third paragraph, again long enough to be content of the page here."
    article = "<html><nav><ul><li><a href=/>Home</a></ul><article><h1>T</h1><p>A &lt;b&gt;<p>c<br>d<section class='comments'><p>no</section></article><footer>f</footer>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", article), (5, "u", article), (6, "u", "plain"), (7, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = html_extract.extract(pages).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == want and by[2] == by[3] == by[4] == "" and by[5] == "T A <b> c d" and by[6] == "plain" and by[7] == " ".join(["word"] * 20_000)
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.where("false")).collect() == []


def test_html_sections_without_article():
    p = lambda k: f"<p>Paragraph {k} is long enough to count as content of this page, surely so.</p>"
    for cut in (8, 9):
        page = f"<html><body><nav><a href=/>Home</a></nav><div id=content><section>{''.join(map(p, range(cut)))}</section><section>{''.join(map(p, range(cut, 11)))}<p>Short.</p></section></div><footer>f</footer>"
        want = " ".join(f"Paragraph {k} is long enough to count as content of this page, surely so." for k in range(11)) + " Short."
        assert html_extract.main_text(page) == want
