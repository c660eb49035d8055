"""Operator 1: exact top-k search for binary codes by incremental multi-index hashing.

A code of `bits` bits is cut into m segments; the index holds each distinct code under each of its segments. If two codes differ in d bits, some
segment differs in at most d / m of them. So when all segments have been probed with all values within radius r of the query's, every
code within m (r + 1) - 1 bits has been met. Round r probes only the values at exactly r bits, and a pair of codes counts only in the round and at
the first segment where it is nearest, so it is verified once in all rounds. A query keeps its k best verified codes; it leaves when
its k-th verified distance is covered, and until then that distance bounds what later rounds let through. From the radius at which a
round's values make up half of all values of a segment, counted over the segments, the queries left are compared with all distinct codes, block
by block, which covers everything. That radius follows from width and segments alone, so tables of every size are searched alike.

Rows of equal codes are one index entry with the k least ids, which is all that a top-k with ties by id can use (the window's group
limit keeps k rows a code before the shuffle, so a hot code costs nothing). A probe is an equi-join on (segment, value); the
distance check is part of the join, so only rows within the query's bound leave it. Equal query codes are searched once.

Defined cases: rows without id or vector are neither found nor ask; missing components count as 0; ties go to the lower id; repeated rows
are found each; fewer than k rows give all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import materialize

BITS, SEGMENTS, K = 64, 4, 10
#: A scan compares blocks of about so many query codes with parts of the distinct codes.
SCAN_BLOCK, SCAN_PARTS = 1024, 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set if component i is above 0; a bigint."""
    flags = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _masks(width: int, weight: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), weight)]


def _scan(active: DataFrame, held: DataFrame, n_active: int) -> DataFrame:
    """Pairs within the bound of each query code left, from all distinct codes: blocks of queries meet parts of the codes in an equi-join."""
    blocks = -(-n_active // SCAN_BLOCK)
    asked = active.groupBy(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("code", "bound")).alias("asked"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SCAN_PARTS - 1))))
    codes = held.withColumn("part", F.pmod(F.xxhash64("found"), F.lit(SCAN_PARTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = F.filter("asked", lambda q: F.bit_count(q["code"].bitwiseXOR(F.col("found"))) <= q["bound"])
    met = codes.join(asked, ["block", "part"]).select("found", "rows", "least_id", F.explode(near).alias("q"))
    return met.select(F.col("q.code").alias("code"), "found", "rows", "least_id", F.bit_count(F.col("q.code").bitwiseXOR(F.col("found"))).alias("distance"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance. codes: vec_id, code; queries: query_id, code."""
    if bits % segments:
        raise ValueError("bits must be a multiple of segments")
    width = bits // segments
    if width > 20:
        raise ValueError("segments of more than 20 bits have too many values to probe")
    codes, queries = codes.filter("vec_id is not null and code is not null"), queries.filter("query_id is not null and code is not null")
    first = Window.partitionBy("code").orderBy("vec_id", "tie")
    rows = materialize(codes.select("vec_id", "code").withColumn("tie", F.monotonically_increasing_id()), "hamming-codes")
    least = materialize(rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).select(F.col("code").alias("found"), "vec_id", "nth"), "hamming-least")
    held = materialize(least.groupBy("found").agg(F.max("nth").alias("rows"), F.min("vec_id").alias("least_id")), "hamming-distinct")

    def segment(code: Column, i: Column) -> Column:
        return F.call_function("shiftrightunsigned", code, (i * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))

    parts = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment")
    index = held.select("found", "rows", "least_id", parts).withColumn("value", segment(F.col("found"), F.col("segment")))
    differing = F.col("code").bitwiseXOR(F.col("found"))
    by_segment = F.array(*[F.bit_count(segment(differing, F.lit(i))) for i in range(segments)])
    asked = materialize(queries.select("query_id", "code").distinct(), "hamming-queries")
    active = materialize(asked.select("code", F.lit(bits).alias("bound")).distinct(), "hamming-active")
    # of a query's verified codes, no more than k can hold its k best rows
    order = [F.col("distance"), F.col("least_id"), F.col("found")]
    best = Window.partitionBy("code").orderBy(*order)
    upto = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept, ended = None, []
    for radius in range(width + 1):
        n_active = active.count()
        if not n_active:
            break
        scan = 2 * segments * comb(width, radius) >= 1 << width
        covered = bits if scan or radius == width else segments * (radius + 1) - 1
        if scan:
            met = _scan(active, held, n_active)
        else:
            masks = F.split(F.lit(",".join(map(str, _masks(width, radius)))), ",").cast("array<bigint>")
            probes = active.select("code", "bound", parts).select("code", "bound", "segment", F.explode(masks).alias("mask"))
            probes = probes.select("code", "bound", "segment", segment(F.col("code"), F.col("segment")).bitwiseXOR(F.col("mask")).alias("value"))
            # the estimate of the probes' size doesn't know of the masks: without the hint they would be broadcast
            met = probes.join(index.hint("shuffle_hash"), ["segment", "value"]).filter(F.bit_count(differing) <= F.col("bound"))
            met = met.filter((F.array_min(by_segment) == radius) & (F.array_position(by_segment, F.lit(radius)) == F.col("segment") + 1))
            met = met.select("code", "found", "rows", "least_id", F.bit_count(differing).alias("distance"))
            met = met if kept is None else met.unionByName(kept)
        met = met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).withColumn("upto", F.sum("rows").over(upto))
        met = met.withColumn("kth", F.min(F.when(F.col("upto") >= k, F.col("distance"))).over(Window.partitionBy("code"))).drop("nth", "upto")
        met = materialize(met, f"hamming-best-{radius}")
        if covered == bits:
            ended.append(met.drop("kth"))
            break
        ended.append(met.filter(F.col("kth") <= covered).drop("kth"))
        kept = met.filter(F.col("kth").isNull() | (F.col("kth") > covered)).drop("kth")
        bounds = met.groupBy("code").agg(F.max("kth").alias("kth"))
        active = active.join(bounds, "code", "left").filter(F.col("kth").isNull() | (F.col("kth") > covered))
        active = materialize(active.select("code", F.coalesce("kth", "bound").alias("bound")), "hamming-active")
    if not ended:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).alias("distance")).limit(0)
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    ranks = Window.partitionBy("code").orderBy("distance", "vec_id", "nth")
    found = found.select("code", "found", "distance").join(least, "found").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
    return asked.join(found, "code").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
