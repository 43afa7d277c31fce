"""Files in parts give what they give as a whole, wherever they are cut; parts of a broken file never leave records out unseen."""

import gzip
import random

import pytest

from readmill.sources import fastq, parts
from readmill.sources.parts import FormatError, Members, Part, blocks, open_at


def in_parts(path, kind, split):
    """Records of all parts, one after the other."""
    out = []
    for start, stop in fastq._ranges(str(path), split):
        with Part(str(path), start, stop) as part:
            for places, columns in blocks(part, kind):
                read = [c.to_pylist() for c in columns()]
                assert len(places) == len(read[0])
                out += list(zip(*read))
    return out


def whole(path, kind):
    return [r[1:] for r in fastq.records(str(path), kind)]


def fastq_text(n, seed=1):
    r = random.Random(seed)
    reads = []
    for k in range(n):
        size = r.choice([0, 1, 5, 40, 300])
        reads.append(f"@r{k} a@b @c\n{''.join(r.choice('ACGTN') for _ in range(size))}\n+{'r' * (k % 2)}\n{''.join(r.choice('@+I!') for _ in range(size))}\n")
    return "".join(reads).encode()


def members(text, sizes, seed=2):
    """A gzip file of members that end anywhere."""
    r, out, at = random.Random(seed), [], 0
    while at < len(text):
        size = r.choice(sizes)
        out.append(gzip.compress(text[at : at + size], mtime=0))
        at += size
    return out


@pytest.mark.parametrize("text", [fastq_text(80), fastq_text(80)[:-1], fastq_text(5).replace(b"\n", b"\r\n"), fastq_text(3) + b"\n\n" + fastq_text(9) + b"\n", b"", b"@a\n\n+\n\n"])
def test_plain_fastq(tmp_path, text):
    path = tmp_path / "r.fq"
    path.write_bytes(text)
    want = whole(path, "fastq")
    assert all(in_parts(path, "fastq", split) == want for split in (1, 2, 3, 7, 50, 333, 4000, 1 << 20) if split > 3 or len(text) < 1000)


def test_blocks_smaller_than_records(tmp_path, monkeypatch):
    monkeypatch.setattr("readmill.sources.parts.BLOCK", 16)
    path = tmp_path / "r.fq"
    path.write_bytes(fastq_text(60))
    assert in_parts(path, "fastq", 500) == whole(path, "fastq")


@pytest.mark.parametrize("sizes", [(1, 2, 30), (100, 700), (5000,), (1 << 20,)])
def test_gzip_members(tmp_path, sizes):
    text, path = fastq_text(120), tmp_path / "r.fq.gz"
    path.write_bytes(b"".join(members(text, sizes)))
    want = whole(path, "fastq")
    assert len(want) == 120 and all(in_parts(path, "fastq", split) == want for split in (17, 100, 1000, 1 << 20))
    path.write_bytes(b"".join(members(text, sizes)) + b"\0" * 50)  # filled up, as tapes are
    assert all(in_parts(path, "fastq", split) == want for split in (100, 1 << 20))


def test_places_that_look_like_members(tmp_path):
    """The magic number within a stored member, and so at places where no member starts."""
    head = gzip.compress(b"x")[:10]
    text = b"@a" + head.replace(b"\n", b"").decode("latin1").encode() + b"\nAC\n+\nII\n"
    stored = gzip.compress(text.replace(b"\xc2\x8b", b"\x8b"), compresslevel=0) * 3
    (tmp_path / "m.gz").write_bytes(stored)
    assert stored.count(b"\x1f\x8b\x08") == 6
    for start in range(1, len(stored)):
        m = Members(str(tmp_path / "m.gz"), start, len(stored))
        assert m.first in (None, len(stored) // 3, 2 * len(stored) // 3) and (m.first is None) == (start > 2 * len(stored) // 3)


@pytest.mark.parametrize("split", [60, 400, 1 << 20])
def test_broken_members_are_errors(tmp_path, split):
    good, path = members(fastq_text(60), (700,)), tmp_path / "r.fq.gz"
    cases = [
        [*good[:4], good[4][:-20]], [*good[:3], good[3][:60] + b"\xff" * 8 + good[3][68:], *good[4:]], [*good[:3], good[3][:-8] + b"\1\2\3\4" + good[3][-4:], *good[4:]], [*good, b"rubbish"],
    ]
    for case in cases:
        path.write_bytes(b"".join(case))
        with pytest.raises(FormatError):
            in_parts(path, "fastq", split)


@pytest.mark.parametrize("split", [5, 40, 1 << 20])
def test_broken_records_are_errors(tmp_path, split):
    path = tmp_path / "r.fq"
    for end in (b"@last\nACGT\n+\nII\n", b"@last\nACGT\n+\n", b"@last\nACGT\n"):
        path.write_bytes(fastq_text(6) + end)
        with pytest.raises(FormatError):
            in_parts(path, "fastq", split)


@pytest.mark.parametrize("packed", [False, True])
def test_fasta(tmp_path, packed):
    r = random.Random(3)
    lines = lambda k: "".join("".join(r.choice("ACGT") for _ in range(r.choice([0, 7, 60]))) + r.choice(["\n", "\r\n", "\n# > no record\n"]) for _ in range(k))
    text = ("# head\n\n" + "".join(f">s{k} x>y\n{lines(r.choice([0, 1, 4, 200]))}" for k in range(25))).encode()
    path = tmp_path / ("r.fa.gz" if packed else "r.fa")
    path.write_bytes(b"".join(members(text, (300, 2000))) if packed else text)
    want = whole(path, "fasta")
    assert len(want) == 25 and max(len(s) for _, s, _ in want) > 2000
    assert all(in_parts(path, "fasta", split) == want for split in (50, 333, 1 << 20))


def test_places_open_where_they_say(tmp_path):
    text = fastq_text(50)
    for name, data in (("r.fq", text), ("r.fq.gz", b"".join(members(text, (1, 50, 600))))):
        path = str(tmp_path / name)
        (tmp_path / name).write_bytes(data)
        rest = [r[1:] for r in fastq.records(path)]
        for start, stop in fastq._ranges(path, 900):
            with Part(path, start, stop) as part:
                for places, _ in blocks(part, "fastq"):
                    for at in places.tolist():
                        with open_at(path, *part.place(at)) as stream:
                            assert stream.readline().decode().strip() == "@" + rest.pop(0)[0]
        assert not rest


def test_source_in_parts(spark, tmp_path):
    text = fastq_text(300)
    (tmp_path / "r.fq.gz").write_bytes(b"".join(members(text, (900,))))
    (tmp_path / "s.fa").write_text("".join(f">s{k}\n" + "ACGT\n" * k for k in range(60)))
    got = fastq.read(spark, str(tmp_path / "r.fq.gz"), split="2000")
    assert got.rdd.getNumPartitions() > 5
    rows = got.orderBy("read_idx").collect()
    assert [tuple(r)[1:] for r in rows] == whole(tmp_path / "r.fq.gz", "fastq") and len({r["read_idx"] for r in rows}) == 300
    fasta = fastq.read(spark, str(tmp_path / "s.fa"), split="700")
    assert fasta.rdd.getNumPartitions() > 5 and [tuple(r)[1:] for r in fasta.orderBy("read_idx").collect()] == [(f"s{k}", "ACGT" * k, None) for k in range(60)]


@pytest.fixture
def sides(tmp_path):
    """Two sides of the same number of reads, in files that end at different reads: (paths, reads) of each."""
    out = []
    for k, cuts in ((1, (0, 130, 130, 400)), (2, (0, 17, 333, 400))):
        records = [f"@r{i}/{k}\n{'ACGT' * (i % (3 + k))}\n+\n{'@III' * (i % (3 + k))}\n" for i in range(400)]
        paths = []
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            path, text = tmp_path / f"{k}-{n}.fq{'.gz' if n == 2 else ''}", "".join(records[a:b]).encode()
            path.write_bytes(b"".join(members(text, (500,))) if n == 2 else text)
            paths.append(str(path))
        out.append(",".join(paths))
    return out


@pytest.mark.parametrize("every, split", [(1, 300), (7, 900), (64, 100_000), (1000, 900)])
def test_lockstep_pairs(spark, sides, every, split):
    df = fastq.read_pairs(spark, *sides, every=every, split=split)
    want = [(i, f"r{i}/1", "ACGT" * (i % 4), f"r{i}/2", "@III" * (i % 5)) for i in range(400)]
    assert [(r["read_idx"], r["r1"]["name"], r["r1"]["sequence"], r["r2"]["name"], r["r2"]["qualities"]) for r in df.collect()] == want  # in order without a sort
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the files are read in lockstep; the index is a stored table by now


@pytest.mark.parametrize("every, split", [(1, 50), (3, 200), (64, 300), (10, 1 << 20)])
def test_interleaved_in_parts(spark, tmp_path, every, split):
    for n, (a, b) in enumerate(((0, 90), (90, 120))):
        (tmp_path / f"{n}.fq").write_text("".join(f"@r{i}/{k}\n{'AC' * (i % 7)}\n+\n{'II' * (i % 7)}\n" for i in range(a, b) for k in (1, 2)))
    df = fastq.read_pairs(spark, f"{tmp_path}/0.fq,{tmp_path}/1.fq", every=every, split=split)
    assert [(r["read_idx"], r["r1"]["name"], r["r2"]["name"]) for r in df.collect()] == [(i, f"r{i}/1", f"r{i}/2") for i in range(120)]


def test_pairs_without_mates_or_reads(spark, tmp_path):
    a, b, none = (str(tmp_path / n) for n in ("a.fq", "b.fq", "none.fq"))
    for path, n in ((a, 5), (b, 4), (none, 0)):
        with open(path, "w") as f:
            f.write("@r\nAC\n+\nII\n" * n)
    for sides in ((a, b), (b, a), (none, a), (a,)):
        with pytest.raises(FormatError, match="without its mate"):
            fastq.read_pairs(spark, *sides)
    assert fastq.read_pairs(spark, none, none).count() == 0 and fastq.read_pairs(spark, none).count() == 0 and fastq.read_pairs(spark, b).count() == 2


def test_small_parts_share_tasks(spark, tmp_path):
    """Tasks don't grow with the number of small parts, and reads and their order are those of one part."""
    text = "".join(f"@r{k}\nACGT{'ACGT' * (k % 9)}\n+\nIIII{'IIII' * (k % 9)}\n" for k in range(8000))
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq.gz").write_bytes(b"".join(gzip.compress(text[k : k + 700].encode()) for k in range(0, len(text), 700)))
    (tmp_path / "c.fasta").write_text("".join(f">r{k}\nACGT\nAC\n" for k in range(8000)))
    for name in ("a.fastq", "b.fastq.gz", "c.fasta"):
        df = fastq.read(spark, str(tmp_path / name), split="300")
        assert 200 < df.rdd.getNumPartitions() <= fastq.TASKS
        assert [r["name"] for r in df.orderBy("read_idx").select("name").collect()] == [f"r{k}" for k in range(8000)]
    got = fastq.read_pairs(spark, str(tmp_path / "a.fastq"), every=16, split=300)
    assert got.rdd.getNumPartitions() <= fastq.TASKS and [r["name"] for r in got.orderBy("read_idx").select("r1.name").collect()] == [f"r{k}" for k in range(0, 8000, 2)]
    assert fastq.tasks_for(52 << 30, 800_000) == 832 and fastq.tasks_for(1 << 20, 16) == 16


def test_parts_read_what_they_hold(tmp_path):
    """A part of a few bytes doesn't read a whole block of the file."""
    path = tmp_path / "a.fastq"
    path.write_text("@r\nACGT\n+\nIIII\n" * 100_000)
    with parts.Part(str(path), 1000, 2000) as part:
        assert sum(len(p) for p, _ in parts.blocks(part, "fastq")) > 50
        assert part.stream.tell() < 2000 + 2 * parts.TAIL
