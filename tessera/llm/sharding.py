"""Sharding over fixed virtual slots.

Every record hashes into one of ``SLOTS`` slots for good. A small versioned map says which shard holds each slot; growing or
rebalancing edits the map and moves whole slots, never rehashing a record. Version 1 deals the slots out in equal runs.
``rebalance`` makes the next version from the bytes per slot: a shard keeps its slots, in slot order, as long as their
running bytes stay within its fair share, and gives up the rest; the given-up slots, laid end to end, fill the gaps of the
shards that are below their share, also laid end to end (new shards begin empty). So only surplus slots move.

Sizes: the map and the byte counts have SLOTS rows whatever the input, so they are broadcast; the documents are never
shuffled for the assignment, and only partial sums per slot are shuffled for the counts.

Edge cases: a null text has 0 bytes; a null id hashes as the text 'null:' plus the md5 of the record's text, so null ids
spread; repeated rows go to the same slot and count each; an empty table gives an all-zero count and a map with no moves;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Virtual slots, 12 bits of the hash.
SLOTS = 4096
#: Shards of the first and of the rebalanced version.
SHARDS, GROWN = 16, 20


def slot(id_col: str = "doc_id", text_col: str = "text"):
    """Slot of a record: the first 12 bits of the md5 of its id."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def slot_bytes(docs: DataFrame) -> DataFrame:
    """slot, bytes, records for all SLOTS slots."""
    counts = docs.select(slot().alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")).groupBy("slot").agg(F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(counts, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records"))


def first_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """Version 1: slot, shard, version."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") * shards / SLOTS).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(now: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for so many shards: slot, shard, version. now: the map; sizes: slot, bytes."""
    spark = now.sparkSession
    s = now.join(F.broadcast(sizes.select("slot", "bytes")), "slot")
    share = s.agg(F.ceil(F.sum("bytes") / shards).cast("long").alias("share"), F.max("version").alias("v"))
    own = s.crossJoin(F.broadcast(share)).withColumn("upto", F.sum("bytes").over(W.partitionBy("shard").orderBy("slot")))
    kept = own.where(f"upto <= share and shard < {shards}")
    given = own.where(f"not (upto <= share and shard < {shards})").withColumn("mid", F.sum("bytes").over(W.partitionBy(F.lit(1)).orderBy("shard", "slot")) - F.expr("bytes - bytes div 2"))
    filled = kept.groupBy("shard").agg(F.sum("bytes").alias("held"))
    gaps = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("to"))
        .join(filled, F.col("to") == F.col("shard"), "left")
        .crossJoin(F.broadcast(share))
        .select("to", F.greatest(F.col("share") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("gap"))
        .withColumn("end", F.sum("gap").over(W.partitionBy(F.lit(1)).orderBy("to")))
        .withColumn("begin", F.col("end") - F.col("gap"))
    )
    # the windows over one partition see at most SLOTS rows
    last = gaps.where("gap > 0").agg(F.max("to").alias("last"))
    moved = given.join(F.broadcast(gaps.where("gap > 0").select("to", "begin", "end")), (F.col("mid") >= F.col("begin")) & (F.col("mid") < F.col("end")), "left").crossJoin(F.broadcast(last)).select("slot", F.coalesce("to", "last", F.least("shard", F.lit(shards - 1))).alias("shard"), (F.col("v") + 1).alias("version"))
    return kept.select("slot", "shard", (F.col("v") + 1).alias("version")).unionByName(moved)


def store(version: DataFrame, path: str) -> None:
    """Add one version of the map to the map table at path; a version that is there already is refused."""
    v = version.first()["version"]
    version.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={v}")


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("slot", "shard", F.col("version").cast("int").alias("version"))


def assign(docs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, slot, bytes, shard, was (the shard in the version before) and moved for each row."""
    both = new.select("slot", "shard").join(old.select("slot", F.col("shard").alias("was")), "slot")
    return (
        docs.select(F.col("doc_id"), slot().alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
        .join(F.broadcast(both), "slot")  # SLOTS rows
        .select("doc_id", "slot", "bytes", "shard", "was", (F.col("shard") != F.col("was")).alias("moved"))
    )


SQL = f"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 3))::int as slot, coalesce(octet_length(encode(text)), 0)::bigint as bytes from documents),
sizes as (select r.slot::int as slot, coalesce(sum(bytes), 0)::bigint as bytes from range({SLOTS}) r(slot) left join d using (slot) group by 1),
now as (select slot, bytes, (slot * {SHARDS} // {SLOTS})::int as shard from sizes),
share as (select ceil(sum(bytes) / {GROWN})::bigint as share from sizes),
own as (select *, sum(bytes) over (partition by shard order by slot)::bigint as upto from now, share),
kept as (select * from own where upto <= share),
given as (select *, sum(bytes) over (order by shard, slot)::bigint - (bytes - bytes // 2) as mid from own where upto > share),
gaps as (select t.t::int as t, greatest(share - coalesce((select sum(bytes) from kept where kept.shard = t.t), 0), 0)::bigint as gap from range({GROWN}) t(t), share),
spans as (select t, gap, sum(gap) over (order by t)::bigint as e, sum(gap) over (order by t)::bigint - gap as b from gaps),
moved as (select slot, coalesce(t, (select max(t) from gaps where gap > 0)) as shard from given left join (select * from spans where gap > 0) on mid >= b and mid < e),
map as (select slot, shard from kept union all select slot, shard from moved)
select doc_id, slot, d.bytes, map.shard::int as shard, now.shard as was, map.shard <> now.shard as moved from d join map using (slot) join now using (slot)
"""
