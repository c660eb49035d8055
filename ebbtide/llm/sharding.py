"""Operator 7: rendezvous hashing of stable record keys over weighted shards.

Each record scores every shard with -ln(u) / weight, where u in (0, 1) comes from the MD5 digest of key and shard
number, and goes to the shard with the least score. The score of a pair depends on nothing else, so one more shard
can only take records into itself: about weight_new / sum(weights) of them move, and none between old shards.

DataFrame functions only. The shard is computed in one scan, which writes narrow rows (id, size, checksum, shard); only these are
shuffled, to number the records of a shard without gaps. Like rows are counted before the shuffle and get a range of slots, which is
spread again where it is long. The numbering is split by (shard, sub-bucket), a hash of key and checksum, so rows that share a key or have
none don't meet in one sort, and the offsets between sub-buckets come from counts that are pre-aggregated before
the shuffle (at most shards x sub_buckets rows, which is why they may be broadcast).

Defined cases: a null key hashes as the empty text; a null text has no bytes and size 16; repeated rows share a
shard and get slots of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import hash_unit, materialize, text_of

ROW_BYTES = 16
SUB_BUCKETS = 256
#: Slots of like rows are handed out in runs of so many.
RUN = 4096


def score(key: Column, shard: Column, weight: Column) -> Column:
    return -F.log(hash_unit(F.concat(key, F.lit(":"), shard.cast("string")))) / weight


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the least score among shards first..first+len(weights)-1."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    table = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_min(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda s: F.struct(score(key, s + F.lit(first), F.element_at(table, s + F.lit(1))).alias("score"), (s + F.lit(first)).cast("int").alias("shard")),
        )
    )


def shard_records(docs: DataFrame, weights: Sequence[float], new_weight: float | None = None, key: str = "doc_id", text: str = "text", sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each record lies, and where it would lie with one more shard."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    new_weight = weights[-1] if new_weight is None else new_weight
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        k.alias("k"),
        (F.octet_length(text_of(text)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).alias("best"),
        rendezvous(k, [new_weight], first=len(weights)).alias("new"),
    )
    sub = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "k", "text_crc32").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(sub_buckets)).cast("int")
    rows = materialize(narrow.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), F.least("best", "new")["shard"].alias("grown_shard"), sub.alias("sub")), "shards")
    counts = rows.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    like = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("shard", "sub").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    like = like.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "sub"]).withColumn("first", F.col("first") + F.col("offset"))
    few = like.filter(F.col("n") <= RUN)
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    many = like.filter(F.col("n") > RUN).withColumn("at", runs).withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("at"))).withColumn("first", F.col("first") + F.col("at"))
    many = many.drop("at").repartition("shard", "first")
    slots = F.explode(F.sequence(F.col("first").cast("long"), (F.col("first") + F.col("n") - 1).cast("long")))
    return few.unionByName(many).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots.alias("slot"), "grown_shard")
