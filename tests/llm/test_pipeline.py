"""The pipeline's stages, one after the other, against plain versions of what each decides."""

import hashlib
import random

import numpy as np
import pytest

random.seed(11)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 9))) for _ in range(400)]


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(n):
    return "\n".join(" ".join(sentence(12) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rows = [(k, prose(4), "en", f"src{k % 3}") for k in range(60)]
    rows += [(60, "spam " * 300, "en", "src0"), (61, "few words", "en", "src0"), (62, rows[3][1], "en", "src1"), (63, " ".join(w + "###" for w in prose(3).split()), "en", "src1")]
    words = rows[5][1].split(" ")
    rows += [(64, " ".join(words[:70] + ["other"] + words[71:]).replace("\n", " "), "en", "src2"), (65, rows[5][1].replace("\n", " "), "en", "src2"), (66, None, None, None)]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r["doc_id"] for r in rows} for rows in seen]
    assert ids[0] == {*range(60), 62, 64, 65}  # repeated, short, symbol-ridden and null texts go
    assert ids[1] == {*range(60), 64, 65}  # 62 is nothing but copied lines
    assert all(r["n_chars"] == len(r["text"]) for r in seen[1])
    assert 5 in ids[2] and not {64, 65} & ids[2]
    assert {r["text"] for r in seen[3]} <= {r["text"] for r in seen[2]} and max(np.unique([r["doc_id"] for r in seen[3]], return_counts=True)[1]) <= 2
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.vocabulary())
    want = sorted((r["doc_id"], hashlib.sha256(np.array(t.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in seen[3])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in seen[4]) == want
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen[4]))
