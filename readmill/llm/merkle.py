r"""Document fingerprints: a Merkle tree over paragraphs and sections; DataFrame operations only.

Leaves are the clauses of a paragraph (a line): characters up to a mark of punctuation, 48 at most, so that the leaves of a
text put together are the text. A paragraph's digest is that of its leaves' digests. A paragraph whose digest starts with
0-3 ends a section, and so does the 65th in it, so that an insertion moves no later section's bounds. The root is the digest of
the sections'. A fingerprint is the root, a colon and the short digests of the leaves: equal roots mean equal texts, and
where roots differ, `likeness` compares the leaves. `tree` keeps every level, and `differences` descends from the root into the
sections and paragraphs that differ, and only these, to the leaves that were removed and added.

Null texts count as empty; an empty text has a fingerprint like any other. Rows that are equal in doc_id and text count once
in the order of documents; rows that share only the doc_id follow in order of a hash of the text; null ids come first. An
empty table gives an empty one. A table of one document has itself for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.llm.common import partitions, written

LEAF = r"[^.!?,;:|]{1,48}+[.!?,;:|]*+|[.!?,;:|]++"
_INNER, _LAST = "[4-9a-f][0-9a-f]*,", "[0-3][0-9a-f]*,"
SECTION = f"(?:{_INNER}){{1,64}}+(?:{_LAST})?+|{_LAST}"
SHORT = 6
#: Stands for a null id.
NO_ID = -(1 << 63)


def leaves_by_paragraph(text: Column) -> Column:
    """For each paragraph an array of its leaves' digests."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x)))


def fingerprint(text: Column) -> Column:
    """The root of the tree, a colon, and the leaves' short digests."""
    paragraphs = lambda leaves: F.transform(leaves, lambda p: F.md5(F.array_join(p, "")))
    sections = lambda leaves: F.transform(F.regexp_extract_all(F.concat(F.array_join(paragraphs(leaves), ","), F.lit(",")), F.lit(SECTION), F.lit(0)), lambda s: F.md5(s))
    short = lambda leaves: F.array_join(F.transform(F.flatten(leaves), lambda x: F.substring(x, 1, SHORT)), "")
    # a transform over an array of one element evaluates the leaves once for both uses
    return F.transform(F.array(leaves_by_paragraph(text)), lambda leaves: F.concat(F.sha2(F.array_join(sections(leaves), ""), 256), F.lit(":"), short(leaves)))[0]


def leaves_of(print_: Column) -> Column:
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f".{{{SHORT}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the number of different leaves in both, by the numbers in each (0 to 1)."""
    x, y = F.array_distinct(leaves_of(a)), F.array_distinct(leaves_of(b))
    both = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: 2.0 * F.size(F.array_intersect(p["x"], p["y"])) / F.greatest(F.size(p["x"]) + F.size(p["y"]), F.lit(1)))[0]
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(both)


TREE = "struct<root:string,sections:array<struct<digest:string,paragraphs:int>>,paragraphs:array<struct<digest:string,leaves:int>>,leaves:array<string>>"


def tree(text: Column) -> Column:
    """The whole tree: root, digests of the sections with their numbers of paragraphs, of the paragraphs with their numbers of leaves, of the leaves."""
    of = lambda leaves: F.transform(leaves, lambda p: F.struct(F.md5(F.array_join(p, "")).alias("digest"), F.size(p).alias("leaves")))
    joined = lambda paragraphs: F.concat(F.array_join(F.transform(paragraphs, lambda p: p["digest"]), ","), F.lit(","))
    sections = lambda paragraphs: F.transform(F.regexp_extract_all(joined(paragraphs), F.lit(SECTION), F.lit(0)), lambda s: F.struct(F.md5(s).alias("digest"), F.length(F.translate(s, "0123456789abcdef", "")).alias("paragraphs")))
    whole = lambda t: F.struct(F.sha2(F.array_join(F.transform(t["sections"], lambda s: s["digest"]), ""), 256).alias("root"), t["sections"].alias("sections"), t["paragraphs"].alias("paragraphs"), t["leaves"].alias("leaves"))
    step = F.transform(F.array(leaves_by_paragraph(text)), lambda leaves: F.struct(of(leaves).alias("paragraphs"), F.flatten(leaves).alias("leaves")))
    step = F.transform(step, lambda t: F.struct(sections(t["paragraphs"]).alias("sections"), t["paragraphs"].alias("paragraphs"), t["leaves"].alias("leaves")))
    return F.transform(step, whole)[0].cast(TREE)


def _under(branches: Column, count: str) -> Column:
    """For each child of the branches, in order, the digest of its branch."""
    return F.flatten(F.transform(branches, lambda b: F.array_repeat(b["digest"], b[count])))


def _only_in(x: Column, y: Column) -> Column:
    """What stands in tree x and not in y, from the root down: only differing branches are looked into. Numbers of leaves."""
    digests = lambda items: F.transform(items, lambda i: i["digest"])
    sections = F.array_except(digests(x["sections"]), digests(y["sections"]))
    paragraphs = F.arrays_zip(digests(x["paragraphs"]).alias("digest"), _under(x["sections"], "paragraphs").alias("section"))
    differing = lambda held: F.array_except(digests(F.filter(paragraphs, lambda p: F.array_contains(held, p["section"]))), digests(y["paragraphs"]))
    leaves = F.transform(F.arrays_zip(x["leaves"].alias("leaf"), _under(x["paragraphs"], "leaves").alias("paragraph")), lambda v, i: F.struct(i.alias("at"), v["leaf"].alias("leaf"), v["paragraph"].alias("paragraph")))
    # a transform over an array of one element evaluates each list of branches once
    inside = F.transform(F.transform(F.array(sections), differing), lambda held: F.filter(leaves, lambda v: F.array_contains(held, v["paragraph"])))
    new = F.transform(inside, lambda held: F.struct(held.alias("held"), F.array_except(F.transform(held, lambda v: v["leaf"]), y["leaves"]).alias("new")))
    return F.transform(new, lambda t: F.transform(F.filter(t["held"], lambda v: F.array_contains(t["new"], v["leaf"])), lambda v: v["at"]))[0]


def differences(a: Column, b: Column) -> Column:
    """removed, added: the numbers of the leaves of tree a that are none of b, and of b that are none of a; and whether the trees have
    the same leaves in another order or number (moved)."""
    same = a["root"] == b["root"]
    none = F.array().cast("array<int>")
    removed, added = (F.when(same, none).otherwise(_only_in(x, y)) for x, y in ((a, b), (b, a)))
    held = F.transform(F.array(F.struct(removed.alias("removed"), added.alias("added"))), lambda d: F.struct(d["removed"].alias("removed"), d["added"].alias("added"), (~same & (F.size(d["removed"]) == 0) & (F.size(d["added"]) == 0)).alias("moved")))
    return held[0]


def edits(a: Column, b: Column) -> Column:
    """Where leaves of fingerprint b are none of a: their numbers in b. `differences` compares whole trees."""
    x, y = leaves_of(a), leaves_of(b)
    return F.filter(F.transform(y, lambda v, i: F.when(~F.array_contains(x, v), i)), lambda i: i.isNotNull())


def in_order(keys: DataFrame) -> DataFrame:
    """Adds next_* and prev_* columns to different keys (id, hash, n): each one's neighbours in ascending order, in a ring."""
    dealt = written(keys.repartitionByRange(partitions(keys.sparkSession), "id", "hash").withColumn("part", F.spark_partition_id()), "ring")
    key = F.struct("id", "hash", "n")
    # one row for each partition: its first and last key, and those of its neighbours
    ends = dealt.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    w, every = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lead("first").over(w), F.min("first").over(every)).alias("after"), F.coalesce(F.lag("last").over(w), F.max("last").over(every)).alias("ahead"))
    near = Window.partitionBy("part").orderBy("id", "hash")
    with_ends = dealt.join(ends, "part")
    return with_ends.select("id", "hash", "n", F.coalesce(F.lead(key).over(near), "after").alias("next"), F.coalesce(F.lag(key).over(near), "ahead").alias("prev"))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document; its edited
    text ends in the head of the next document instead of its own second half."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # the same three columns for texts and for heads, so that texts are shuffled once
    source = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("hash"), text.alias("text"))
    keys = source.groupBy("id", "hash").agg(F.max(F.length("text")).alias("n"))
    ring = written(in_order(keys), "ring")
    half = lambda n: F.floor(n / 2).cast("int")
    known = source.join(ring, ["id", "hash"]).withColumn("print", fingerprint(F.col("text")))
    heads = known.withColumn("copy", F.row_number().over(Window.partitionBy("id", "hash").orderBy("n"))).where("copy = 1")
    heads = heads.select(F.col("prev.id").alias("id"), F.col("prev.hash").alias("hash"), F.expr("substring(text, 1, cast(floor(prev.n / 2) as int))").alias("head"), F.col("print").alias("next_print"))
    out = known.join(heads, ["id", "hash"], "left")
    edited = F.concat(F.expr("substring(text, 1, cast(n - floor(n / 2) as int))"), F.coalesce("head", F.lit("")))
    out = out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), edited.alias("edited"), F.col("print").alias("fingerprint"), "next_print")
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near, likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
