"""Operator 10: mixing sources to target weights by Pareto order sampling.

1. Sources, by code point with null last, take weights 1, 2, 3, repeating, and share the words of the whole corpus by
   weight. A target stops at max_repeat times its source's size; what is over goes to the others by weight. The closed
   form sorts sources by cap / weight and finds the level at which the rest is shared (water filling), so no loop is needed.
2. A source's target is `whole` copies of each of its documents, allocated for certain, and a rest of r words. The rest is an
   unequal-probability sample: a document's inclusion probability is p = lambda * sqrt(size), at most 1, so that long documents come in
   oftener (a word of a short document weighs more than one of a long document). Documents of p = 1 are taken for certain; lambda is such
   that the expected words, sum of p * size, are r. Sizes are whole numbers, so it is found exactly from one row for each size of
   a source: with sizes descending, the certain ones are a prefix, and lambda of each possible prefix is a ratio of sums.
3. Pareto order sampling: with random odds u / (1 - u), u from the digest of seed, doc_id and text, documents rank by random odds over
   inclusion odds p / (1 - p). The sample is the longest prefix of that order which fits in what the certain ones leave of r. Then at
   most three closing documents, each the unselected one whose size is nearest to the gap left, are added while that brings the
   source nearer to its target.

DataFrame functions only. A source may hold a third of all rows, so no window runs over a source: documents are binned by
their rank value (4096 bins for each source), bins are summed with map-side combining, the bin in which the prefix ends is found from
those sums, and only its rows (at most about 1/4096 of the source) are put in order.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id and a null text draw as the
empty text; a document of size 0 is taken `whole` times (it adds no words); rows that repeat id, text and source rank side by side and are told
apart by a number within their like; an empty table gives an empty result. No document is taken more than max_repeat times. The result
is the same on each run, however the files are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import WORD, fresh_name, hash_unit, materialize, sift

BINS = 4096
#: Documents of a source that may follow the prefix to close the gap to its target.
CLOSING = 3
#: Like rows are numbered in so many parts.
PARTS = 64
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target, whole, rest from rows of source and size. The windows run over one row for each source."""
    everything = Window.partitionBy(F.lit(0))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("nth", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    table = F.array(*[F.lit(int(w)) for w in weights])
    src = src.withColumn("weight", F.element_at(table, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    src = src.withColumn("cap", F.col("source_size") * F.lit(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = everything.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    src = src.withColumn("level", left.cast("double") / shares.cast("double")).withColumn("capped", F.col("ratio") <= F.col("level"))
    src = src.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    whole = F.when(F.col("capped"), F.lit(max_repeat)).otherwise(F.floor(F.try_divide("target", "source_size"))).cast("long")
    src = src.withColumn("whole", F.coalesce(whole, F.lit(0).cast("long")))
    return src.select("source", "source_size", "target", "whole", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)).alias("rest"))


def _key(seed: str, doc_id: Column, text: Column, source: Column) -> Column:
    """What a row draws by."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), content, F.coalesce(F.concat(F.lit("s"), source), F.lit(""))).cast("binary"))


def numbered(df: DataFrame, key: str, nth: str) -> DataFrame:
    """df with numbers 0, 1, ... among rows of one key. Only rows that share their key are moved, in parts, so that a key of very many rows is
    not one task's work; which of them gets which number is open."""
    at, part, other, before = (fresh_name(n, df) for n in ("row_at", "row_part", "row_other", "row_before"))
    shared = materialize(df.groupBy(F.col(key).alias(other)).count().filter("count > 1").select(other), "mix-shared")
    alone, asked = sift(df, [F.col(key)], shared, [F.col(other)])
    alone = alone.unionByName(asked.join(shared, F.col(key) == F.col(other), "left_anti")).withColumn(nth, F.lit(0).cast("long"))
    like = asked.join(shared, F.col(key) == F.col(other)).drop(other).withColumn(at, F.monotonically_increasing_id())
    like = materialize(like.withColumn(part, F.pmod(at, F.lit(PARTS))), "mix-like")
    upto = Window.partitionBy(other).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = like.groupBy(F.col(key).alias(other), part).count().select(other, F.col(part).alias(before), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(nth))
    within = F.row_number().over(Window.partitionBy(key, part).orderBy(at)) - 1
    like = like.withColumn(at, within).join(counts, (F.col(key) == F.col(other)) & (F.col(part) == F.col(before)))
    return alone.unionByName(like.withColumn(nth, (F.col(nth) + F.col(at)).cast("long")).drop(at, part, other, before))


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, rate, top, certain: p of a size is 1 above `top`, and rate * floor(1024 * sqrt(size)) up to it; `certain` words lie above.

    One row for each size of a source, however many documents have it."""
    by_size = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    rest = plan.select(F.col("source").alias("source_r"), "rest").filter("rest > 0")
    by_size = by_size.join(rest, F.col("source").eqNullSafe(F.col("source_r"))).withColumn("words", F.col("n") * F.col("size"))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * measure(F.col("size"))).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = by_size.select("source", "size", "rest", larger.alias("larger"), mass.alias("mass")).withColumn("rate", (F.col("rest") - F.col("larger")) / F.col("mass"))
    each = each.filter(F.col("rate") * measure(F.col("size")) < 1).groupBy("source").agg(F.max(F.struct("size", "rate", "larger")).alias("m"))
    return each.select("source", F.col("m.rate").alias("rate"), F.col("m.size").alias("top"), F.col("m.larger").alias("certain"))


def measure(size: Column) -> Column:
    """Whole numbers, so that sums are exact in any order."""
    return F.floor(F.lit(1024) * F.sqrt(size.cast("double"))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, bins: int = BINS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs; with the row's key and its number among rows of that key."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.greatest(F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("size"),
        _key(seed, F.col(doc_id), F.col(text), F.col(source)).alias("key"),
    )
    sizes = numbered(materialize(narrow, "mix-rows"), "key", "nth")
    draw = F.when(F.col("nth") == 0, F.col("key")).otherwise(F.concat("key", F.lit(":"), F.col("nth").cast("string")))
    sizes = materialize(sizes.withColumn("u", hash_unit(draw)), "mix-sizes")
    plan = targets(sizes, weights, max_repeat)
    plan = materialize(plan, "mix-targets")

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """right has one row for each source; Spark broadcasts it if its files are small, and splits the hot source otherwise."""
        return left.join(right.withColumnRenamed("source", "source_r"), F.col("source").eqNullSafe(F.col("source_r")), how).drop("source_r")

    plan = materialize(by_source(plan, inclusion(sizes, plan), "left"), "mix-plan")
    p = F.when(F.col("size") > F.col("top"), F.lit(1.0)).otherwise(F.col("rate") * measure(F.col("size")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = by_source(sizes, plan).withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("sure", F.col("p") >= 1)
    ranked = ranked.withColumn("left_over", F.col("rest") - F.coalesce("certain", F.lit(0)))
    ranked = ranked.withColumn("q", F.when((F.col("p") > 0) & ~F.col("sure"), odds))
    ranked = ranked.withColumn("bin", F.floor((1 - 1 / (1 + F.col("q"))) * bins).cast("int"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = ranked.filter("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("left_over").alias("left_over"))
    binned = binned.withColumn("upto", F.sum("words").over(order))
    cut = binned.filter("upto > left_over").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cut = materialize(cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before")), "mix-cut")
    # only the bin in which the prefix ends is put in full order; `last` is the last row of the prefix
    place = F.struct("q", "key", "nth")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("q", "key", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = by_source(ranked, cut).filter("bin = cut_bin").withColumn("fits", F.col("before") + upto <= F.col("left_over"))
    edge = edge.groupBy("source", "left_over", "cut_bin", "before").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("inside"), F.max(F.when(F.col("fits"), place)).alias("last"))
    ends = materialize(edge.select("source", "cut_bin", "last", (F.col("left_over") - F.col("before") - F.col("inside")).alias("gap")), "mix-ends")
    chosen = by_source(ranked, ends, "left")
    inside = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    chosen = chosen.withColumn("fits", F.col("q").isNotNull() & inside)
    mine = F.concat("key", F.lit(":"), F.col("nth").cast("string"))
    closed = ends.select("source", "gap", F.array().cast("array<string>").alias("closing"))
    for _ in range(CLOSING):
        off = F.abs(F.col("gap") - F.col("size"))
        free = by_source(chosen.drop("gap"), closed).filter(F.col("q").isNotNull() & ~F.col("fits") & (off < F.abs("gap")) & ~F.array_contains("closing", mine))
        found = free.groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", mine.alias("row"), "size")).alias("m"))
        closed = by_source(closed, found, "left")
        closed = closed.select("source", (F.col("gap") - F.coalesce("m.size", F.lit(0))).alias("gap"), F.concat("closing", F.when(F.col("m").isNull(), F.array().cast("array<string>")).otherwise(F.array("m.row"))).alias("closing"))
        closed = materialize(closed, "mix-closing")
    out = by_source(chosen.drop("gap"), closed, "left")
    copies = F.col("whole") + F.when(F.col("sure") | F.col("fits") | F.coalesce(F.array_contains("closing", mine), F.lit(False)), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "p", "key", "nth")


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: of rows alike in id, text and source, as many copies in all as mix says for them."""
    own, each, key, nth, number = (fresh_name(n, docs) for n in ("mix_key", "mix_each", "mix_other", "mix_nth", "mix_number"))
    column = lambda name: docs[options.get(name, name)]
    copies = mix(docs, **options).select(F.col("key").alias(key), F.col("nth").alias(nth), F.col("copies").cast("int").alias(each)).filter(F.col(each) > 0)
    rows = numbered(docs.withColumn(own, _key(options.get("seed", SEED), column("doc_id"), column("text"), column("source"))), own, number)
    rows = rows.join(materialize(copies, "mix-copies"), (F.col(own) == F.col(key)) & (F.col(number) == F.col(nth)))
    rows = rows.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(each))))
    return rows.drop(own, each, key, nth, number)
