"""Token counts: texts are encoded in batches inside Arrow functions that return lengths only.

Long texts are cut at safe boundaries: ASCII white space, and in pieces without it places that the vocabulary cuts at too (see
`pieces`). The pieces of a stretch of texts are counted once each: those not seen lately go to the library in batches of about
equal bytes, and only their lengths are kept, in a memory of bounded bytes. A vocabulary whose tokens cross white space
encodes whole texts. Null and empty texts have no tokens; equal rows give equal results; extra columns are dropped; an empty
table gives an empty one. Memory follows the longest stretch without any boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import map_batches, rows, safe_parts, utf8
from readmill.llm.pieces import SHORT, Coder, by_bytes, opened

BATCH_BYTES = 1 << 19


def _counts(coder: Coder, texts: list[bytes], batch_bytes: int) -> list[int]:
    if not coder.cuts:
        return [len(ids) for some in by_bytes(texts, batch_bytes) for ids in coder.encoded(some)]
    cut, memo, known = [t.split() for t in texts], coder.memo, coder.memo.now
    here: dict[bytes, int] = {}
    new: list[tuple[bytes, bytes]] = []
    for p in {p for c in cut for p in c if p not in known}:
        here[p] = memo.older.get(p, 0)  # every piece has a token
        if not here[p]:
            new += [(p, part) for part in safe_parts(p)]
    at = 0
    for some in by_bytes([part for _, part in new], batch_bytes):
        for (p, _), ids in zip(new[at:], coder.encoded(some)):
            here[p] += len(ids)
        at += len(some)
    counts = []
    for c in cut:
        got = list(map(known.get, c))
        counts.append(sum([here[p] if n is None else n for n, p in zip(got, c)]) if None in got else sum(got))
    for p, n in here.items():
        if len(p) <= SHORT:
            memo.put(p, n)
    return counts


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens without special tokens added, over_limit (n_tokens > limit)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(vocabulary, "counts")
        for batch in batches:
            texts = utf8(batch, "text")
            counts = [n for part in by_bytes(texts, 8 * batch_bytes) for n in _counts(coder, part, batch_bytes)]
            yield rows(out, [batch.column("doc_id").cast(pa.int64()), [len(t) for t in texts], counts])

    counted = map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
