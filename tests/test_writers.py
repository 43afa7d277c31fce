"""Outputs by name: names from the input can't lead out of the folder, and nothing that was there goes unasked."""

import bz2
import os

import pytest
from pyspark.sql import functions as F

from readmill.sources import fastq, writers


@pytest.fixture
def reads(spark):
    return lambda *bins: spark.createDataFrame([(f"r{k}", "ACGT", "IIII", b) for k, b in enumerate(bins)], "name string, sequence string, qualities string, bin string")


def all_files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


@pytest.mark.parametrize("name", ["..", ".", "", "a/b", "../esc", "/tmp/x", "a\\b", "a\nb"])
def test_hostile_names(spark, reads, tmp_path, name):
    (tmp_path / "keep.txt").write_text("mine")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other.txt").write_text("mine too")
    with pytest.raises(Exception, match="name of a folder"):
        writers.write_named(reads("fine", name), f"{tmp_path}/out/{{name}}", (F.col("bin"),))
    assert all_files(tmp_path) == ["keep.txt", "out/other.txt"]


def test_names_with_odd_characters_and_nulls(spark, reads, tmp_path):
    odd = ["a b", "x=y", "50%", "Zürich", "..a", "{name}"]
    out = writers.write_named(reads(*odd, None), f"{tmp_path}/{{name}}.fq", (F.col("bin"),))
    assert sorted(out) == sorted(f"{tmp_path}/{n}.fq" for n in odd)
    assert {p: fastq.read(spark, p).count() for p in out} == dict.fromkeys(out, 1)


def test_existing_folders(spark, reads, tmp_path):
    template = f"{tmp_path}/out/{{name}}"
    writers.write_named(reads("a", "b"), template, (F.col("bin"),))
    before = all_files(tmp_path)
    with pytest.raises(FileExistsError, match="already"):
        writers.write_named(reads("b", "c"), template, (F.col("bin"),))
    assert all_files(tmp_path) == before  # neither c nor a staging area
    writers.write_named(reads("b", "b", "c"), template, (F.col("bin"),), overwrite=True)
    assert [fastq.read(spark, f"{tmp_path}/out/{n}").count() for n in "abc"] == [1, 2, 1]
    (tmp_path / "out" / "b" / "notes.txt").write_text("mine")
    with pytest.raises(FileExistsError, match="holds more"):
        writers.write_named(reads("b"), template, (F.col("bin"),), overwrite=True)
    assert (tmp_path / "out" / "b" / "notes.txt").read_text() == "mine"


def test_two_names(spark, reads, tmp_path):
    df = reads("a", "b").withColumn("second", F.lit("z"))
    out = writers.write_named(df, f"{tmp_path}/{{name1}}-{{name2}}", (F.col("bin"), F.col("second")))
    assert out == [f"{tmp_path}/a-z", f"{tmp_path}/b-z"]


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_sources_open_what_writers_wrote(spark, reads, tmp_path, form):
    path = form.format(f"{tmp_path}/reads")
    writers.write(reads("a", "b", "c"), path)
    assert fastq.read(spark, path).count() == 3
    assert writers.scratch(spark, "x").startswith("file:/")


def files_of(folder):
    """The lines of each folder, files in order of names."""
    found = {}
    for path in all_files(folder):
        if path.endswith(".bz2"):
            with bz2.open(f"{folder}/{path}", "rt", newline="\n") as stream:
                found.setdefault(os.path.dirname(path), []).append(stream.read())
    return {d: "".join(t) for d, t in found.items()}


def test_bzip2_is_compressed_by_tasks_in_python(spark, tmp_path):
    """By the library that Python has (blocks of 100 kB), not by Hadoop's codec in Java; folders and lines are those of Spark's writer."""
    odd = ["a b", "x=y", "50%", "Zürich", "{n}", 'q"\'*:?[]^#', "", None]
    rows = [(f"r{k}", "ACGT" * (k % 5), None if k % 11 == 0 else "IIII" * (k % 5), odd[k % 8]) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, sequence string, qualities string, bin string").repartition(3).cache()
    df.select("bin", writers.record().alias("value")).write.partitionBy("bin").option("compression", "bzip2").text(f"{tmp_path}/spark")
    for folder in ("ours of\ttabs", "ours of\ttabs"):  # the second takes the place of the first
        writers.write(df, f"{tmp_path}/{folder}", compression="bzip2", partition_by=("bin",))
    ours, theirs = files_of(f"{tmp_path}/ours of\ttabs"), files_of(f"{tmp_path}/spark")
    assert set(ours) == set(theirs) and all(sorted(ours[d].split("\n")) == sorted(theirs[d].split("\n")) for d in ours)
    assert "_SUCCESS" in all_files(f"{tmp_path}/ours of\ttabs") and not any("_temporary" in f for f in all_files(tmp_path))
    for path in all_files(f"{tmp_path}/ours of\ttabs"):
        if path.endswith(".bz2"):
            with open(f"{tmp_path}/ours of\ttabs/{path}", "rb") as stream:
                assert stream.read(4) == b"BZh1"


def test_bzip2_keeps_the_order_and_nothing_of_failed_jobs(spark, reads, tmp_path):
    df = spark.range(0, 50_000, 1, 4).selectExpr("concat('r', id) AS name", "repeat('ACGT', id % 9) AS sequence", "repeat('IIII', id % 9) AS qualities", "id")
    writers.write(df, f"{tmp_path}/out", compression="bzip2")
    assert [r["name"] for r in fastq.read(spark, f"{tmp_path}/out").orderBy("read_idx").collect()] == [f"r{k}" for k in range(50_000)]
    before = all_files(tmp_path)
    with pytest.raises(Exception, match="no such read"):
        writers.write(df.withColumn("name", F.when(F.col("id") == 49_999, F.raise_error(F.lit("no such read"))).otherwise(F.col("name"))), f"{tmp_path}/out", compression="bzip2")
    assert all_files(tmp_path) == before
    writers.write(df.where("id < 0"), f"{tmp_path}/none", compression="bzip2")
    assert fastq.read(spark, f"{tmp_path}/none").count() == 0
    first, second = writers.write_pairs(df.selectExpr("struct(name, sequence, qualities) AS r1", "struct(name, sequence, qualities) AS r2"), f"{tmp_path}/pairs", compression="bzip2")
    assert fastq.read(spark, first, second).where("r1.name = r2.name").count() == 50_000
    writers.write_named(reads("b", "a", "b", None), f"{tmp_path}/named/{{name}}.fastq", (F.col("bin"),), compression="bzip2")
    assert [fastq.read(spark, f"{tmp_path}/named/{n}.fastq").count() for n in "ab"] == [1, 2]


def test_gzip_is_compressed_fast(spark, tmp_path):
    """At level 1, as by the tools users come from; Spark's own is 6, which takes four times as long for a few per cent."""
    letters = "translate(concat(md5(cast(id AS string)), md5(concat('a', id))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    df = spark.range(0, 20_000, 1, 1).selectExpr("concat('r', id) AS name", f"{letters} AS sequence", "repeat('I', 64) AS qualities", "id % 2 AS bin")
    size = lambda folder: sum(os.path.getsize(f"{folder}/{f}") for f in all_files(folder) if f.endswith(".gz"))
    df.select(writers.record().alias("value")).write.option("compression", "gzip").text(f"{tmp_path}/spark")
    writers.write(df, f"{tmp_path}/ours", compression="gzip")
    writers.write(df, f"{tmp_path}/bins", compression="gzip", partition_by=("bin",))
    assert size(f"{tmp_path}/ours") > 1.02 * size(f"{tmp_path}/spark") and size(f"{tmp_path}/bins") > 1.02 * size(f"{tmp_path}/spark")
    assert fastq.read(spark, f"{tmp_path}/ours").drop("read_idx").exceptAll(df.drop("id", "bin")).isEmpty()
