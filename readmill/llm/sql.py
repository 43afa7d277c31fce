"""The queries that SQL can express, in DuckDB's dialect, written from their definitions and not from the operators' steps."""

from __future__ import annotations

# What a leaf and a section are, as patterns; the golden ratio's part below one, and 2^26 times it, less whole numbers.
LEAF = '[^.!?,;:|]{1,48}[.!?,;:|]*|[.!?,;:|]+'
SECTION = '(?:[4-9a-f][0-9a-f]*,){1,64}(?:[0-3][0-9a-f]*,)?|[0-3][0-9a-f]*,'
LOW, HIGH, SPLIT = 0.6180339887498949, 0.8983942233824622, 67108864

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (g), range(0, 13) AS t(k) WHERE f < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)"""

LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
d AS (SELECT doc_id, all_lines, list_filter(range(1, len(all_lines) + 1), lambda i: regexp_matches(all_lines[i], '[^\x20\x09-\x0D]')) AS pos FROM split),
l AS (SELECT *, list_transform(pos, lambda i: all_lines[i]) AS lines FROM d),
windows AS (SELECT doc_id, t, i, lines[i : i + t - 1] AS g FROM l, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS a(t), unnest(range(1, len(lines) - t + 2)) AS b(i)),
found AS (SELECT doc_id, t, i, first_value(doc_id) OVER w AS of_doc, first_value(i) OVER w AS of_i FROM windows WINDOW w AS (PARTITION BY t, g ORDER BY doc_id, i)),
copies AS (SELECT * FROM found WHERE (doc_id, i) <> (of_doc, of_i)),
gone AS (SELECT DISTINCT doc_id, i FROM copies WHERE t = 1),
longest_here AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY t DESC) = 1),
in_a_row AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, of_doc, i - of_i ORDER BY i) AS run FROM longest_here),
runs AS (SELECT doc_id, max(i + t) - min(i) AS n FROM in_a_row GROUP BY doc_id, of_doc, i - of_i, run),
of_doc AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest FROM runs GROUP BY doc_id),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
deep AS (SELECT doc_id, max(t) AS t FROM copies GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, CAST(coalesce(t, 0) AS BIGINT) AS deepest,
  sha256(array_to_string(list_filter(all_lines, lambda x, i: gone IS NULL OR NOT list_contains(list_transform(gone, lambda j: pos[j]), i)), chr(10))) AS kept_sha256
FROM l LEFT JOIN lost USING (doc_id) LEFT JOIN of_doc USING (doc_id) LEFT JOIN deep USING (doc_id)"""

MIXING = f"""
WITH sizes AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST(k % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0 * source_size AS cap FROM s),
filled AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
goal AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, k LIMIT 1) * weight) AS target FROM filled),
whole AS (SELECT sum(target) AS total, greatest(1, least(4096, CAST(floor(sum(target) / (2000 * count(*))) AS BIGINT))) AS block FROM goal),
spans AS (SELECT *, coalesce(lag(e) OVER (ORDER BY k), 0) AS b FROM (SELECT *, sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (SELECT total FROM whole) AS e FROM goal)),
points AS (SELECT x - floor(x) AS u FROM (SELECT floor(n / {SPLIT}) * CAST({HIGH!r} AS DOUBLE) + (n % {SPLIT}) * CAST({LOW!r} AS DOUBLE) AS x FROM (SELECT unnest(range(0, CAST(ceil(total / block) AS BIGINT))) AS n FROM whole))),
slots AS (SELECT k, count(*) AS n FROM points JOIN spans ON u >= b AND (u < e OR k = (SELECT max(k) FROM spans)) GROUP BY k),
placed AS (SELECT sizes.*, g.k, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY g.k ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes JOIN goal g ON sizes.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
  CAST(greatest(least(stop, start + size) - start, 0) + greatest(least(stop, start + size + source_size) - start - source_size, 0) AS BIGINT) AS taken
FROM (SELECT placed.*, least(coalesce(n, 0) * (SELECT block FROM whole), 2 * source_size) AS stop FROM placed LEFT JOIN slots USING (k))"""


def _print(text: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x)))"
    sections = f"list_transform(regexp_extract_all(array_to_string(list_transform({leaves}, lambda p: md5(array_to_string(p, ''))), ',') || ',', '{SECTION}'), lambda s: md5(s))"
    return f"sha256(array_to_string({sections}, '')) || ':' || array_to_string(list_transform(flatten({leaves}), lambda x: substr(x, 1, 6)), '')"


def _likeness(a: str, b: str) -> str:
    leaves = lambda p: f"list_distinct(regexp_extract_all(split_part({p}, ':', 2), '.{{6}}'))"
    return f"CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / greatest(len({leaves(a)}) + len({leaves(b)}), 1) END"


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS after, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS head FROM documents),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(coalesce(after, head), 1, length(text) // 2) AS edited FROM d),
p AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_print('text')} AS fingerprint, {_print('edited')} AS edited_fingerprint, {_print('coalesce(after, head)')} AS n FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness('fingerprint', 'edited_fingerprint')} AS near_edited, {_likeness('fingerprint', 'n')} AS near_next FROM p"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS g FROM words),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, least(s.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = s.doc_id), s.doc_id)) AS class_id, (SELECT count(*) FROM links WHERE links.a = s.doc_id) AS n_links,
  CASE WHEN len(g) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY g) END AS set_id, CAST(len(g) AS BIGINT) AS n_grams
FROM sets s"""


def _crc32(text: str) -> str:
    """CRC-32 bit by bit: the reversed polynomial 0xEDB88320."""
    bits = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295), 4294967295)"


SHARDING = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS crc FROM documents),
sums AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(greatest(1, sum(size) // 192) AS BIGINT) AS most FROM d),
heavy AS (SELECT crc, size, true AS heavy FROM d GROUP BY crc, size HAVING count(*) > 1 AND count(*) * size > (SELECT most FROM sums)),
copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, crc, size) - 1 AS copy FROM d LEFT JOIN heavy USING (crc, size)),
bundled AS (SELECT *, CASE WHEN heavy THEN copy // greatest(1, (SELECT most FROM sums) // size) ELSE 0 END AS bundle FROM copies),
keyed AS (SELECT *, crc || ':' || size || CASE WHEN heavy THEN ':' || coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || bundle ELSE '' END AS key FROM bundled),
slotted AS (SELECT *, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 8192 AS virtual FROM keyed),
slots AS (SELECT virtual, virtual % 24 AS shard, CAST(sum(size) AS BIGINT) AS bytes FROM slotted GROUP BY virtual),
larger AS (SELECT bytes, row_number() OVER w - 1 AS k, (SELECT total FROM sums) - sum(bytes) OVER w + bytes AS rest FROM slots WINDOW w AS (ORDER BY bytes DESC, virtual ROWS UNBOUNDED PRECEDING)),
share AS (SELECT rest, 24 - k AS n FROM larger WHERE k = 23 OR bytes * (24 - k) <= rest ORDER BY k LIMIT 1),
running AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual) * (SELECT n FROM share) <= (SELECT rest FROM share) AS stays FROM slots),
kept AS (SELECT virtual, shard, bytes FROM running WHERE stays),
moving AS (SELECT virtual, bytes, row_number() OVER (ORDER BY bytes DESC, virtual) AS i FROM running WHERE NOT stays),
loads AS (SELECT list(CAST(coalesce(x, 0) AS BIGINT) ORDER BY shard) AS loads FROM (SELECT unnest(range(24)) AS shard) LEFT JOIN (SELECT shard, sum(bytes) AS x FROM kept GROUP BY shard) USING (shard)),
steps AS (SELECT CAST(0 AS BIGINT) AS i, loads, CAST(NULL AS BIGINT) AS virtual, CAST(NULL AS BIGINT) AS shard FROM loads
  UNION ALL SELECT m.i, list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN m.bytes ELSE 0 END), m.virtual, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT)
  FROM steps JOIN moving m ON m.i = steps.i + 1),
homes AS (SELECT virtual, shard FROM kept UNION ALL SELECT virtual, shard FROM steps WHERE i > 0)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual, crc, size, doc_id NULLS FIRST, bundle) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM slotted JOIN homes USING (virtual)"""


def _features(table: str) -> str:
    return rf"SELECT * EXCLUDE (text), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


IMPORTANCE = f"""
WITH d AS ({_features("documents")}), b AS ({_features("benchmark")}),
each AS (SELECT doc_id, unnest(w) AS word FROM d), target AS (SELECT unnest(w) AS word FROM b),
buckets AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM target)),
s AS (SELECT bucket, count(*) AS n FROM each JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
weights AS (SELECT doc_id, sum(gain) AS weight FROM each JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


HARD_NEGATIVES = """
WITH fine AS (SELECT * FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM fine),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


ORACLE = {"op2_substring_dedup": SUBSTRING_DEDUP, "op3_line_dedup": LINE_DEDUP, "op7_mixing": MIXING, "op9_merkle": MERKLE, "op10_ngram_jaccard": NGRAM_JACCARD, "op11_sharding": SHARDING, "op12_importance": IMPORTANCE, "op13_hard_negatives": HARD_NEGATIVES}
