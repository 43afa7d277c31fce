"""Sharding over fixed virtual slots; DataFrame operations only.

A record is hashed into one of SLOTS slots, whose number never changes. The bytes of each slot are summed, and a small versioned table maps
slots to shards. Version 1 deals the slots out in turn. To rebalance, the map is edited: each shard keeps its heaviest slots up to
its fair share, and the slots beyond go, heaviest first, to the shard that has least. To grow, slots move to the new shard and nowhere else. The
versions stay in a folder, one below another, so that any earlier placing can be read again; records are never hashed anew.

Records with one text share a slot, and so a shard, whatever their ids. A text whose copies hold more than 1/HEAVY of all bytes would make a slot
that no map can balance: its records are hashed with their ids, which spreads them over all slots, and equal records (one id, one text)
with a number for each bundle of them too. Such texts are fewer than HEAVY, so the list of them is small whatever the input.

Equal records are counted before anything is shuffled. What is collected is a row for each slot (SLOTS at most); what is broadcast is the map and the list of
heavy texts. Places in a shard are running totals inside slots, each a small part of the rows, on top of the rows of the slots before it.

The size of a record is its text's UTF-8 bytes plus OVERHEAD; null and empty texts have none. Null ids are ids of their own, first in order. Texts
count as equal if their CRC-32 and their size are: what that decides is only whether they share a slot. Rows that agree in id, size and CRC get
places one after another. A record larger than a shard's share makes its shard so much larger; it isn't cut. An empty table gives an empty one.
Further columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readmill.llm.common import qualified, shared_dir, written

SLOTS, OVERHEAD = 8192, 8
#: Copies of one text with more than this part of all bytes are spread.
HEAVY = 192


def slot_of(text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record's key: the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots))


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and n: how many rows have these."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc")).groupBy("doc_id", "size", "crc").agg(F.count("*").alias("n"))


def into_slots(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds bundle and slot to the records; equal ones of a heavy text become bundles of at most 1/HEAVY of all bytes (or of one)."""
    total = found.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    most = max(1, total // HEAVY)
    texts = found.groupBy("crc", "size").agg(F.sum("n").alias("copies")).where(F.col("copies") * F.col("size") > most)
    heavy = texts.where("copies > 1").select("crc", "size", F.lit(True).alias("heavy"))  # each has more than 1/HEAVY of all bytes
    marked = found.join(F.broadcast(heavy), ["crc", "size"], "left")
    per = F.greatest(F.floor(F.lit(most) / F.col("size")), F.lit(1))
    bundles = F.when(F.col("heavy") & (F.col("n") > 1), F.ceil(F.col("n") / per)).otherwise(1).cast("int")
    cut = marked.withColumn("per", per).withColumn("bundle", F.explode(F.sequence(F.lit(0), bundles - 1)))
    n = F.when(F.col("heavy") & (F.col("n") > 1), F.least(F.col("per"), F.col("n") - F.col("bundle") * F.col("per"))).otherwise(F.col("n"))
    text = F.concat_ws(":", "crc", "size")
    key = F.when(F.col("heavy"), F.concat_ws(":", text, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "bundle")).otherwise(text)
    return cut.select("doc_id", "size", "crc", n.cast("long").alias("n"), "bundle", slot_of(key, slots).cast("int").alias("slot"))


def loads(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """slot, bytes, rows of each slot with records: SLOTS rows at most."""
    return [tuple(r) for r in slotted.groupBy("slot").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows")).orderBy("slot").collect()]


def dealt(slots: int, shards: int) -> list[int]:
    """The first version of a map: slots in turn. The shard of each slot."""
    return [s % shards for s in range(slots)]


def even_share(size: dict[int, int], shards: int) -> tuple[int, int]:
    """What the shards would hold if slots larger than a share had shards of their own: bytes, and the number of shards that divide them."""
    rest, left = sum(size.values()), shards
    for x in sorted(size.values(), reverse=True):
        if left == 1 or x * left <= rest:
            break
        rest, left = rest - x, left - 1
    return rest, left


def rebalanced(owner: list[int], size: dict[int, int], shards: int) -> list[int]:
    """The map with as few slots moved as it takes: a shard keeps its heaviest slots as long as together they stay within an even share."""
    out, (rest, left) = list(owner), even_share(size, shards)
    held: dict[int, list[int]] = defaultdict(list)
    for s in sorted(size, key=lambda s: (-size[s], s)):
        held[out[s]].append(s)
    full, moving = [0] * shards, []
    for shard, mine in held.items():
        running = 0
        for s in mine:
            running += size[s]
            if running * left <= rest:
                full[shard] = running
            else:
                moving.append(s)
    least = [(x, shard) for shard, x in enumerate(full)]
    heapq.heapify(least)
    for s in sorted(moving, key=lambda s: (-size[s], s)):
        x, shard = heapq.heappop(least)
        out[s] = shard
        heapq.heappush(least, (x + size[s], shard))
    return out


def grown(owner: list[int], size: dict[int, int], shards: int) -> list[int]:
    """The map for one shard more than `shards`: slots move to the new one alone, from each shard down to its share of what is then even."""
    out, (rest, left) = list(owner), even_share(size, shards + 1)
    held: dict[int, list[int]] = defaultdict(list)
    for s in sorted(range(len(out)), key=lambda s: (-size.get(s, 0), s)):
        held[out[s]].append(s)
    share = room = rest // left
    for _, mine in sorted(held.items()):
        over = sum(size.get(s, 0) for s in mine) - share
        spare = len(mine) // (shards + 1)  # of slots without records too, so that later ones find a place there
        for s in mine:
            x = size.get(s, 0)
            if x and x <= min(over, room):
                out[s], over, room = shards, over - x, room - x
            elif not x and spare:
                out[s], spare = shards, spare - 1
    return out


def map_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few thousand rows of numbers as a table."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ",".join(c.strip().replace(" ", ":", 1) for c in schema.split(","))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{fields}>>")).alias("x")).select("x.*")


class SlotMap:
    """Versions of a slot-to-shard map below a folder that driver and executors share; each is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, qualified(spark, folder)

    def add(self, version: int, owner: list[int], size: dict[int, int], shards: int) -> None:
        rows = [(s, shard, size.get(s, 0)) for s, shard in enumerate(owner)]
        table = map_table(self.spark, rows, "slot int, shard int, bytes bigint").withColumn("shards", F.lit(shards))
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/version={version}")

    def read(self, version: int) -> DataFrame:
        """slot, shard, bytes, shards."""
        return self.spark.read.schema("slot int, shard int, bytes long, shards int").parquet(f"{self.folder}/version={version}")

    def owner(self, version: int) -> list[int]:
        return [r[0] for r in self.read(version).orderBy("slot").select("shard").collect()]


def placed(slotted: DataFrame, shard_of: DataFrame, rows: dict[int, int]) -> DataFrame:
    """A row for each row of the input: doc_id, size, text_crc32, shard, slot (its place in the shard, from 0 without gaps)."""
    spark = slotted.sparkSession
    before, bases = defaultdict(int), []
    for s, shard in sorted((r["slot"], r["shard"]) for r in shard_of.collect()):
        if s in rows:
            bases.append((s, shard, before[shard]))
            before[shard] += rows[s]
    where = map_table(spark, bases, "slot int, shard int, base bigint")  # a row for each slot
    in_slot = Window.partitionBy("slot").orderBy("crc", "size", F.col("doc_id").asc_nulls_first(), "bundle").rowsBetween(Window.unboundedPreceding, -1)
    at = slotted.withColumn("at", F.coalesce(F.sum("n").over(in_slot), F.lit(0))).join(F.broadcast(where), "slot")
    first = F.col("base") + F.col("at")
    each = F.when(F.col("n") == 1, F.array(first)).otherwise(F.sequence(first, first + F.col("n") - 1))
    return at.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.explode(each).alias("slot"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null: this law says nothing of one shard more) of each row. The map's versions stay
    in `folder`: 1 as dealt, 2 rebalanced by bytes, by which the rows are placed."""
    spark = docs.sparkSession
    slotted = written(into_slots(written(records(docs), "shard-records"), slots), "shard-slots")
    found = loads(slotted)
    size, rows = {s: b for s, b, _ in found}, {s: n for s, _, n in found}
    maps = SlotMap(spark, folder or shared_dir(spark, "slot-map"))
    maps.add(1, dealt(slots, shards), size, shards)
    maps.add(2, rebalanced(maps.owner(1), size, shards), size, shards)
    out = placed(slotted, maps.read(2), rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
