"""Counts of parts of the reads add up to those of the whole, whatever the parts; sections made by Spark are those of the whole report."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from readmill.plans import report
from readmill.plans.pipeline import Filters, Options, Trimming, run, run_pairs
from readmill.plans.spec import BACK, FRONT, IDENTIFIERS, KINDS, Search, SpecError, adapters, fasta
from readmill.sources import fastq, writers
from readmill.streaming import running

SPECS = [(BACK, "one=ACGTACGT"), (FRONT, "two=GGTGG"), (FRONT, "both=TTTT...CCCC"), (FRONT, "never=^ACACACACACGGGGGGGGGG")]
OPTIONS = Options(Trimming(quality=(0, 10), adapters=adapters(SPECS, Search(max_errors=0.2)), poly_a=True, rc=True), filters=Filters(min_length=5))


def some_reads(spark, n=300):
    r = random.Random(4)
    letters = lambda k: "".join(r.choice("ACGT") for _ in range(k))
    made = [r.choice(["", "GGTGG", "TTTT"]) + letters(r.randrange(20)) + r.choice(["", "ACGTACGT", "ACGTAC", "CCCC", "A" * 12]) + letters(r.randrange(4)) for _ in range(n)]
    return spark.createDataFrame([(k, f"r{k}", s, "".join(r.choice("I#") for _ in s)) for k, s in enumerate(made)], fastq.SINGLE)


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_counts_add_up(spark, parts):
    reads = some_reads(spark)
    whole = report.counts(run(reads, OPTIONS))
    each = [report.counts(run(reads.where(F.col("read_idx") % parts == k), OPTIONS)) for k in range(parts)]
    assert rows(report.merged(*each)) == rows(whole)
    assert rows(report.merged(report.merged(*each[1:]), each[0]) if parts > 1 else report.merged(whole)) == rows(whole)
    if parts == 7:
        merged = report.merged(*each, whole.limit(0))
        for made in (report.json_value, report.json_short):
            assert made(report.Totals(merged, OPTIONS)) == made(report.Totals(run(reads, OPTIONS), OPTIONS))
        assert report.text_report(merged, OPTIONS) == report.text_report(run(reads, OPTIONS), OPTIONS) and report.minimal_report(merged) == report.minimal_report(run(reads, OPTIONS))


def test_sections(spark):
    counted = report.counts(run(some_reads(spark), OPTIONS)).persist()
    value = report.json_value(report.Totals(counted, OPTIONS))
    made = report.sections(counted, OPTIONS).orderBy("side", "number").collect()
    assert [json.loads(r["section"]) for r in made] == json.loads(json.dumps(value["adapters_read1"])) and [r["adapter"] for r in made] == ["one", "two", "both", "never"]
    assert [a["total_matches"] > 0 for a in value["adapters_read1"]] == [True, True, True, False]
    assert set(IDENTIFIERS) == set(KINDS) and value["adapters_read1"][0]["three_prime_end"]["type"] == "regular_three_prime"
    none = report.sections(counted.limit(0), OPTIONS).collect()
    assert len(none) == 4 and all(json.loads(r["section"])["total_matches"] == 0 for r in none)


def test_sections_of_pairs(spark):
    both = some_reads(spark).select("read_idx", *(F.struct("name", "sequence", "qualities").alias(f"r{k}") for k in (1, 2)))
    options = Options(OPTIONS.first, Trimming(adapters=OPTIONS.first.adapters[:2]), Filters(min_length=5))
    counted = report.counts(run_pairs(both, options))
    value = report.json_value(report.Totals(counted, options))
    assert [(r["side"], json.loads(r["section"])) for r in report.sections(counted, options).orderBy("number").collect()] == [(k, a) for k in (1, 2) for a in json.loads(json.dumps(value[f"adapters_read{k}"]))]
    short = report.json_short(report.Totals(counted, options))
    assert sum(a["reads"] for a in short["adapters"]) == sum(e["matches"] for k in (1, 2) for a in report.Totals(counted, options).adapters(k) for e in report.Totals(counted, options).of_adapter(k, a)["ends"].values() if e)


def test_counts_of_a_stream(spark, tmp_path):
    """Files in several batches; a second start takes new files only, and a batch run again replaces its counts."""
    reads = some_reads(spark)
    (tmp_path / "in").mkdir()
    all_rows = [r.asDict() for r in reads.orderBy("read_idx").collect()]

    def put(name, part):
        (tmp_path / "in" / name).write_text("".join(f"@{r['name']}\n{r['sequence']}\n+\n{r['qualities']}\n" for r in part))

    def go():
        running.write_counts(running.read_stream(spark, str(tmp_path / "in"), "fastq", maxFilesPerTrigger="1"), OPTIONS, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()

    put("a.fq", all_rows[:100])
    put("b.fq", all_rows[100:150])
    go()
    put("c.fq", all_rows[150:])
    go()
    assert len(list((tmp_path / "counts").glob("batch=*"))) == 3
    assert rows(running.stored_counts(spark, str(tmp_path / "counts"))) == rows(report.counts(run(reads, OPTIONS)))


def test_adapters_from_files(tmp_path):
    (tmp_path / "a.fa").write_text("# adapters\n>one of them\nACG\nT\n>\nGG\n")
    with gzip.open(tmp_path / "a.fa.gz", "wb") as f:
        f.write((tmp_path / "a.fa").read_bytes())
    for name in ("a.fa", "a.fa.gz"):
        assert fasta(str(tmp_path / name)) == [("one", "ACGT"), ("", "GG")]
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(SpecError):
        fasta(str(tmp_path / "bad.fa"))


def test_pairs_by_fate(spark, tmp_path):
    mates = [(k, (f"r{k}/1", "A" * (k % 9), "I" * (k % 9)), (f"r{k}/2", "C" * 9, "I" * 9), ("written", "too_short", "too_long")[k % 3]) for k in range(500)]
    df = spark.createDataFrame(mates, fastq.PAIRED + ", fate string").repartition(3)
    out = {f: (f"{tmp_path}/out/{f}_1.fq", f"{tmp_path}/out/{f}_2.fq") for f in ("written", "too_short")}
    assert writers.write_pair_fates(df, out) == sorted(p for both in out.values() for p in both)
    for k, (fate, paths) in enumerate(out.items()):
        got = [(r["r1"]["name"], r["r2"]["name"]) for r in fastq.read_pairs(spark, *paths).collect()]
        assert sorted(got) == sorted((f"r{n}/1", f"r{n}/2") for n in range(500) if n % 3 == k)
    with pytest.raises(FileExistsError):
        writers.write_pair_fates(df, out)
    with pytest.raises(ValueError, match="one folder"):
        writers.write_pair_fates(df, {"written": ("a/x", "b/y")})
