"""Sources, sinks, modifiers, actions, pairs, bins, statistics and streams on small reads."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from readmill.functions import reads as R
from readmill.operators import demux, records, stats
from readmill.operators import trim as T
from readmill.plans.pipeline import Filters, Options, Trimming, run, run_pairs
from readmill.plans.report import json_report, minimal_report, text_report
from readmill.plans.spec import ANYWHERE, BACK, FRONT, Search, adapter, adapters
from readmill.sources import fastq, writers
from readmill.streaming import running

EXACT = Search(max_errors=0)


def frame(spark, *reads):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(reads)], "read_idx long, name string, sequence string, qualities string")


def one(spark, column, s="ACGT", q="IIII", name="r"):
    return frame(spark, (name, s, q)).select(column.alias("x")).first()["x"]


@pytest.fixture
def fastq_file(tmp_path):
    path = tmp_path / "r.fastq"
    path.write_text("".join(f"@r{k} c\r\n{'ACGT' * (k % 5)}\n+\n{'@III' * (k % 5)}\n" for k in range(200)) + "\n")
    return path


def test_fastq_in_parts(spark, fastq_file, tmp_path):
    whole = [tuple(r)[1:] for r in fastq.read(spark, str(fastq_file)).orderBy("read_idx").collect()]
    assert len(whole) == 200 and whole[1] == ("r1 c", "ACGT", "@III")
    parts = fastq.read(spark, str(fastq_file), split="97")
    assert parts.rdd.getNumPartitions() > 10 and [tuple(r)[1:] for r in parts.orderBy("read_idx").collect()] == whole
    packed = tmp_path / "r.fastq.gz"
    packed.write_bytes(gzip.compress(fastq_file.read_bytes()[:500].rpartition(b"@r")[0]) + gzip.compress(b"@last\nA\n+\nI\n"))
    assert [r["name"] for r in fastq.read(spark, str(packed)).orderBy("read_idx").collect()][-1] == "last"


def test_fasta_and_errors(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_text("# c\n>a b\nAC\n\nGT\n>c\n")
    assert [tuple(r)[1:] for r in fastq.read(spark, str(path)).orderBy("read_idx").collect()] == [("a b", "ACGT", None), ("c", "", None)]
    for text in ("@r\nACGT\n+\nIII\n", "@r\nACGT\nIIII\n", "r\n", "@r\nACGT\n"):
        path.write_text(text)
        with pytest.raises(fastq.FormatError):
            list(fastq.records(str(path)))


def test_pairs_and_interleaved(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.fq").write_text("".join(f"@r{i}/{k}\nAC\n+\nII\n" for i in range(5)))
    pairs = fastq.read(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).orderBy("read_idx").collect()
    assert [(p["r1"]["name"], p["r2"]["name"]) for p in pairs] == [(f"r{i}/1", f"r{i}/2") for i in range(5)]
    (tmp_path / "i.fq").write_text("".join(f"@r{i}/{k}\nAC\n+\nII\n" for i in range(3) for k in (1, 2)))
    assert [(p["r1"]["name"], p["r2"]["name"]) for p in fastq.read(spark, str(tmp_path / "i.fq"), layout="interleaved").orderBy("read_idx").collect()] == [(f"r{i}/1", f"r{i}/2") for i in range(3)]
    (tmp_path / "2.fq").write_text("@r0/2\nAC\n+\nII\n")
    with pytest.raises(Exception, match="without its mate"):
        fastq.read(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect()


def test_write_and_read_back(spark, fastq_file, tmp_path):
    df = fastq.read(spark, str(fastq_file), split="500")
    want = [tuple(r)[1:] for r in df.orderBy("read_idx").collect()]
    writers.write(df, str(tmp_path / "out"), compression="gzip")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert all(f.name.endswith(".gz") for f in files)
    assert [r[1:] for f in files for r in fastq.records(str(f))] == want
    assert [r["value"] for r in writers.as_text(frame(spark, ("a", "AC", None), ("b", "AC", "II"))).collect()] == [">a\nAC", "@b\nAC\n+\nII"]
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "x"), compression="xz")


def test_spans(spark):
    s, q = F.col("sequence"), F.col("qualities")
    span = lambda c, **k: tuple(one(spark, c, **k))
    assert span(R.cut_ends(s, 9)) == (4, 4) and span(R.cut_ends(s, -9)) == (0, 0) and one(spark, R.removed_end(s, -3)) == "CGT"
    assert span(R.quality_span(q, 0, 10), s="ACGTAC", q="IIII##") == (0, 4) and span(R.quality_span(q, 10, 10), q="####") == (0, 0)
    assert span(R.nextseq_span(s, q, 20), s="ACTTGG", q="IIIIII") == (0, 4)
    assert span(R.poly_span(s), s="CCAAAAACAAAA", q="I" * 12) == (0, 2) and span(R.poly_span(s), s="CCAA") == (0, 4) and span(R.poly_span(s, True), s="TTTTC", q="IIIII") == (4, 5)
    assert span(R.n_ends_span(s), s="NNACnn", q="I" * 6) == (2, 4) and span(R.n_ends_span(s), s="NNNN") == (4, 4)
    assert span(R.poly_span(s), s="", q="") == (0, 0) and one(spark, R.quality_span(q, 0, 5), q=None) is None


def test_names_and_predicates(spark):
    s, q, n = F.col("sequence"), F.col("qualities"), F.col("name")
    assert one(spark, R.length_tag(n, "len=", s), name="a len=99 b") == "a len=4 b" and one(spark, R.strip_suffix(n, "/1"), name="r/1") == "r"
    assert one(spark, R.rename("{id}_x {comment}\\t{rc}", R.rename_columns(n, is_rc=F.lit(True))), name="a b c") == "a_x b c\trc"
    with pytest.raises(R.TemplateError):
        R.rename("{nothing}", {})
    assert one(spark, R.zero_cap(q, 64), q="@A#h") == "@A@h" and one(spark, R.reverse_complement(s), s="ACGTNa") == "tNACGT"
    assert one(spark, R.too_many_n(s, 0.5), s="NNAC") is False and one(spark, R.too_many_n(s, 1), s="NNAC") is True and one(spark, R.too_many_n(s, 0.1), s="", q="") is False
    assert one(spark, R.expected_errors(q), q="++++") == pytest.approx(0.4) and one(spark, R.too_many_errors(q, 0.1), q=None) is False
    assert one(spark, R.casava_filtered(n), name="r 1:Y:0") is True and one(spark, R.casava_filtered(n), name="r:Y: 1:N:0") is False


def test_actions(spark):
    reads = frame(spark, ("a", "CCCCAAGTTTTCAAGGG", "I" * 17), ("b", "gggg", "IIII"))
    plan = [adapter("CAAG", ANYWHERE, EXACT)]
    got = lambda action, times=1: [r["sequence"] for r in T.trim(reads, plan, times, action).orderBy("read_idx").collect()]
    assert got("trim") == ["CCC", "gggg"] and got("mask") == ["CCC" + "N" * 14, "gggg"] and got("retain") == ["CCCCAAG", "gggg"]
    assert got("crop") == ["CAAG", "gggg"] and got("lowercase") == ["CCCcaagttttcaaggg", "GGGG"] and got("none") == ["CCCCAAGTTTTCAAGGG", "gggg"]
    with pytest.raises(ValueError):
        got("other")


def test_linked_records_and_rest(spark):
    reads = frame(spark, ("r1", "AAAAAAAAAACCCCCCCCCCTTTTTTTTTTGGG", "I" * 33), ("r2", "GGGGGGG", "I" * 7))
    found = T.find_adapters(reads, [adapter("l=AAAAAAAAAA...TTTTTTTTTT", FRONT, EXACT)])
    lines = [r["value"] for r in records.info_lines(records.info_records(found).orderBy("name", "match_no")).collect()]
    assert lines[0].split("\t")[:8] == ["r1", "0", "0", "10", "", "A" * 10, "C" * 10 + "T" * 10 + "GGG", "l;1"]
    assert lines[1].split("\t")[:8] == ["r1", "0", "10", "20", "C" * 10, "T" * 10, "GGG", "l;2"] and lines[2].split("\t") == ["r2", "-1", "GGGGGGG", "IIIIIII"]
    assert [tuple(r) for r in records.rest_records(found).collect()] == [("GGG", "r1")]
    assert [r["sequence"] for r in T.apply_action(found, "retain").orderBy("read_idx").collect()] == ["A" * 10 + "C" * 10 + "T" * 10, "GGGGGGG"]


def test_strands_and_pair_adapters(spark):
    reads = frame(spark, ("f", "CCCCACGTAA", "ABCDEFGHIJ"), ("r", "TTACGTGGGG", "ABCDEFGHIJ"))
    out = T.apply_action(T.best_strand(reads, [adapter("ACGTAA", BACK, EXACT)])).orderBy("read_idx").collect()
    assert [(r["name"], r["sequence"], r["qualities"], r["is_rc"]) for r in out] == [("f", "CCCC", "ABCD", False), ("r rc", "CCCC", "JIHG", True)]
    pair = lambda a, b: (dict(name="n", sequence=a, qualities="I" * len(a)), dict(name="n", sequence=b, qualities="I" * len(b)))
    schema = "read_idx long, r1 struct<name:string,sequence:string,qualities:string>, r2 struct<name:string,sequence:string,qualities:string>"
    pairs = spark.createDataFrame([(0, *pair("GGGACACAC", "GGGTGTGTG")), (1, *pair("GGGACACAC", "GGGG")), (2, *pair("GGGG", "GGGG"))], schema)
    sides = (Trimming(adapters=[adapter("ACACAC", BACK, EXACT)]), Trimming(adapters=[adapter("TGTGTG", BACK, EXACT)]))
    got = lambda o: [(r["r1"]["sequence"], r["r2"]["sequence"], r["fate"]) for r in run_pairs(pairs, o).orderBy("read_idx").collect()]
    assert got(Options(*sides, pair_adapters=True)) == [("GGG", "GGG", "written"), ("GGGACACAC", "GGGG", "written"), ("GGGG", "GGGG", "written")]
    fates = {m: [x[2] for x in got(Options(*sides, filters=Filters(min_length=4), pair_filter=m))] for m in ("any", "both", "first")}
    assert fates == {"any": ["too_short", "too_short", "written"], "both": ["too_short", "written", "written"], "first": ["too_short", "too_short", "written"]}
    bins = demux.demultiplex_pairs(run_pairs(pairs, Options(*sides))).orderBy("read_idx").collect()
    assert [(r["bin1"], r["bin2"]) for r in bins] == [("1", "1"), ("1", "unknown"), ("unknown", "unknown")]


def test_index_join_same_as_search(spark):
    plans = adapters([(FRONT, f"{n}=^{s}") for n, s in (("x", "ACGTACGT"), ("y", "TTGGCCAA"))], Search(max_errors=0.25, indels=False))
    reads = frame(spark, *((f"r{k}", s, "I" * len(s)) for k, s in enumerate(["ACGTACGTCC", "ACGAACGTCC", "TTGGCCTTGG", "GGGGGGGGGG", "AC"])))
    searched = {(r["name"], r["m"]["adapter"], r["m"]["errors"]) for r in T.find_adapters(reads, plans).where("size(matches) > 0").selectExpr("name", "matches[0] AS m").collect()}
    assert {tuple(r)[1:] for r in T.index_join(reads.select("read_idx", "name", "sequence"), plans).select("read_idx", "name", "adapter", "errors").collect()} == searched and len(searched) == 3


@pytest.mark.parametrize("search", [Search(max_errors=0.25), Search(max_errors=0.25, indels=False)])
@pytest.mark.parametrize("codes", ["ACGTACGT TTGGCCAA TTGGCCAATG", "ACGTNCGT TTGGCCAA TTGGCCAATG"])
def test_index_join_keeps_what_the_search_finds(spark, search, codes):
    plans = adapters([(FRONT, f"b{k}=^{s}") for k, s in enumerate(codes.split())], search)
    starts = ["ACGTACGTCC", "ACGTACGTCC", "ACGACGTCCC", "ACGTTACGTC", "ACNTACGTCC", "NNNTACGTCC", "acgtacgtcc", "TTGGCCAATG", "TTGGCCAANG", "TTGCCAATGC", "GGGGGGGGGG", "AC", ""]
    reads = spark.createDataFrame([("r", s) for s in starts], "name string, sequence string")
    found = T.find_adapters(reads, plans).where("size(matches) > 0").selectExpr("name", "sequence", "matches[0].adapter", "matches[0].errors").collect()
    got = T.index_join(reads, plans)
    assert got.columns == ["name", "sequence", "adapter", "errors"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, found))
    assert sum(r["sequence"] == "ACGTACGTCC" for r in found) == 2 and any("N" in r["sequence"] for r in found)


def test_run_statistics_and_reports(spark, tmp_path):
    reads = frame(spark, *[(f"r{k}", "CCCCC" + "ACGTACGT"[: k % 9] , "I" * (5 + k % 9)) for k in range(90)], ("n", "NNNNNN", "IIIIII"))
    out = run(reads, Options(Trimming(adapters=[adapter("ACGTACGT", BACK)], trim_n=True), filters=Filters(min_length=3)))
    assert tuple(stats.summary(out, "original", "sequence", "matches", "fate").first())[:4] == (91, 816, 60, 90)
    found = stats.ends(out, sequence="original")
    assert {r["removed"]: r["reads"] for r in stats.adapter_histogram(found).collect()} == {k: 10 for k in range(3, 9)}
    assert [tuple(r) for r in stats.adjacent_bases(found).collect()] == [("1", "C", 60, 1.0, True)]
    expect = {r["removed"]: (r["expect"], r["error_counts"]) for r in stats.expected_matches(stats.adapter_histogram(found), [adapter("ACGTACGT", BACK)], 91).collect()}
    assert expect[3] == (pytest.approx(91 / 64), [10])
    report = json.loads(json_report(out).first()["report"])
    assert report["read_counts"] == {"reads": 91, "with_adapter": 60, "written": 90} and report["filtered"] == {"too_short": 1}
    assert "Reads with adapters: 60 (65.9%)" in text_report(out) and minimal_report(out).split("\n")[1].startswith("OK\t91\t816\t1\t")
    demux.write_bins(demux.demultiplex(out), str(tmp_path / "bins"))
    assert {p.name for p in (tmp_path / "bins").glob("bin=*")} == {"bin=1", "bin=unknown"}


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fastq").write_text("".join(f"@r{k}\nACGTACGT\n+\nIIIIIIII\n" for k in range(10)))
    options = Options(Trimming(adapters=[adapter("ACGT$", BACK, EXACT)]), filters=Filters(min_length=3))
    query = running.write_trimmed(running.read_stream(spark, str(folder)), options, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    (folder / "b.fastq").write_text("@x\nAC\n+\nII\n@y\nTTTT\n+\nIIII\n")
    running.write_trimmed(running.read_stream(spark, str(folder)), options, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 11 and {r["sequence"] for r in rows} == {"ACGT", "TTTT"}


def test_stream_of_files_in_any_order_of_names(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, *reads):
        (tmp_path / name).write_text("".join(f"@{r}\nACGT\n+\nIIII\n" for r in reads))
        (tmp_path / name).rename(folder / name)
        running.write_trimmed(running.read_stream(spark, str(folder)), Options(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)  # a new query: a restart
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert arrive("b.fastq", "b1", "b2") == ["b1", "b2"]
    assert arrive("a.fastq", "a1") == ["a1", "b1", "b2"]
    assert arrive("c.fastq", "c1") == ["a1", "b1", "b2", "c1"]


def test_writers_run_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = frame(spark, *[(f"r{k}", "ACGT", "IIII") for k in range(100)]).repartition(3).mapInArrow(count, "read_idx long, name string, sequence string, qualities string")
    writers.write(df, str(tmp_path / "one"))
    assert seen.value == 100
    pair = lambda k: F.struct(F.concat("name", F.lit(f"/{k}")).alias("name"), "sequence", "qualities").alias(f"r{k}")
    folders = writers.write_pairs(df.select("read_idx", pair(1), pair(2)), str(tmp_path / "two"), compression="gzip")
    assert seen.value == 200
    names = [[r[1][:-2] for f in sorted(__import__("pathlib").Path(p).glob("part-*")) for r in fastq.records(str(f))] for p in folders]
    assert names[0] == names[1] and sorted(names[0]) == sorted(f"r{k}" for k in range(100))


def test_outputs_by_fate_and_by_name(spark, tmp_path):
    reads = frame(spark, ("a", "ACGTACGTTT", "I" * 10), ("b", "ACG", "III"), ("c", "GGGGGGGGGGGG", "I" * 12))
    plans = adapters([(BACK, "first=ACGTTT")], EXACT)
    out = run(reads, Options(Trimming(adapters=plans), filters=Filters(min_length=4, discard_untrimmed=True)))
    got = writers.write_fates(out, {"written": f"{tmp_path}/f/kept", "too_short": f"{tmp_path}/f/short.fastq"})
    assert [p.rpartition("/")[2] for p in got] == ["kept", "short.fastq"]
    read = lambda p: [r["name"] for r in fastq.read(spark, p).collect()]
    assert read(f"{tmp_path}/f/kept") == ["a"] and read(f"{tmp_path}/f/short.fastq") == ["b"]
    demux.write_bins(demux.demultiplex(out), f"{tmp_path}/bins/x-{{name}}.fq")
    assert sorted(p.name for p in (tmp_path / "bins").iterdir()) == ["x-first.fq", "x-unknown.fq"]
    both = out.select(F.struct("name", "sequence", "qualities").alias("r1"), F.col("matches").alias("matches1"), F.col("matches").alias("matches2"))
    demux.write_bins(demux.demultiplex_pairs(both), f"{tmp_path}/pairs/{{name1}}-{{name2}}", ("bin1", "bin2"), prefix="r1.")
    assert sorted(p.name for p in (tmp_path / "pairs").iterdir()) == ["first-first", "unknown-unknown"]


def test_pairs_from_files_in_parts(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.fq").write_text("".join(f"@r{i}/{k}\n{'ACGT' * (i % (3 + k))}\n+\n{'IIII' * (i % (3 + k))}\n" for i in range(300)))
    got = fastq.read_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), split="700").orderBy("read_idx").collect()
    assert [(r["read_idx"], r["r1"]["name"], r["r2"]["name"]) for r in got] == [(i, f"r{i}/1", f"r{i}/2") for i in range(300)]
    (tmp_path / "2.fq").write_text("@r0/2\nAC\n+\nII\n")
    with pytest.raises(fastq.FormatError, match="without its mate"):
        fastq.read_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"))


def test_reports_in_full(spark):
    reads = frame(spark, *[(f"r{k}", "CCCCC" + "ACGTACGT"[: k % 9], "I" * (5 + k % 9)) for k in range(90)], ("n", "AA", "II"), ("p", "CGCGCG" + "A" * 10, "I" * 13 + "###"))
    options = Options(Trimming(quality=(0, 10), adapters=adapters([(BACK, "one=ACGTACGT"), (FRONT, "two=GGGGG")], EXACT), poly_a=True), filters=Filters(min_length=3))
    value = json.loads(json_report(run(reads, options), options).first()["report"])
    assert value["read_counts"] == {"input": 92, "filtered": {f: int(f == "too_short") for f in value["read_counts"]["filtered"]}, "output": 91, "reverse_complemented": None, "read1_with_adapter": 60, "read2_with_adapter": None}
    assert value["basepair_counts"]["quality_trimmed"] == 3 and value["poly_a_trimmed_read1"] == [{"len": 7, "count": 1}]
    one_, two = value["adapters_read1"]
    assert one_["five_prime_end"] is None and one_["three_prime_end"]["dominant_adjacent_base"] == "C" and two["total_matches"] == 0
    assert one_["three_prime_end"]["trimmed_lengths"][0] == {"len": 3, "expect": round(92 / 64, 1), "counts": [10]} and one_["three_prime_end"]["error_lengths"] == [8]
    text = text_report(run(reads, options), options)
    for part in ("=== Adapter one ===", "Sequence: ACGTACGT; Type: regular 3'; Length: 8; Trimmed: 60 times", "3\t10\t1.4\t0\t10", "  C: 100.0%", "WARNING:", "=== Poly-A ===", "7\t1", "=== Adapter two ==="):
        assert part in text
    pairs = reads.select("read_idx", F.struct("name", "sequence", "qualities").alias("r1"), F.struct("name", "sequence", "qualities").alias("r2"))
    paired = Options(Trimming(adapters=options.first.adapters, rc=True), Trimming(adapters=options.first.adapters), Filters(min_length=3))
    value = json.loads(json_report(run_pairs(pairs, paired), paired).first()["report"])
    assert value["read_counts"]["read2_with_adapter"] == 60 and value["adapters_read2"][0]["total_matches"] == 60 and value["read_counts"]["reverse_complemented"] is not None
    assert "=== Second read: Adapter one ===" in text_report(run_pairs(pairs, paired), paired) and minimal_report(run_pairs(pairs, paired), paired).split("\n")[0].endswith("w/adapters2")


def test_combined_pair_filter(spark):
    read = lambda s: F.struct(F.lit("r").alias("name"), F.lit(s).alias("sequence"), F.lit("I" * len(s)).alias("qualities"))
    pair = spark.range(1).select(read("AC").alias("r1"), read("ACGTNNN").alias("r2"))
    fate = lambda **k: run_pairs(pair, Options(Trimming(), Trimming(), Filters(min_length=4, max_n=1), **k)).first()["fate"]
    assert fate(pair_filter="both") == "written" and fate(pair_filter="both", combined=True) == "too_short" and fate(combined=True) == "too_short"
