"""Operator 4: token counts by way of a digest cache.

The cache is a folder of Parquet batches (content digest, tokenizer digest, n_tokens) in the shared store. A count takes
four steps: digest each text (SHA-256 of its bytes, null as empty: no other normalisation, as any would change counts); find the
distinct digests that the cache lacks for this tokenizer's digest; encode one document of each; append the counts as a
new batch. The counts then come back by digest.

Texts move once, and only to the representative's task: the digest table is a few dozen bytes a row, the representative of a digest is its
least doc_id (pre-aggregated before the shuffle, so copies cost nothing), and the join back by digest is a plain equi-join
that Spark splits where one digest holds many rows. A batch becomes visible only when Spark's writer has committed it, so a
lost executor or a killed run leaves no half batch; two runs that add the same digests do no harm, as reads take one row a digest.

Defined cases: a null text counts as empty (0 tokens); repeated rows are counted once and reported each; null ids are
kept; an empty table gives an empty result and adds nothing to the cache; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import broadcast_file, map_arrow, materialize, text_of
from ebbtide.llm.pieces import table_for

LIMIT = 4096


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: another version never meets these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str, content: bytes):
    """A function from texts to counts; made on the worker."""
    if path.endswith(".model"):
        return table_for(content).count
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(content)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty if there is no cache yet."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "digest binary, version string, n_tokens long"
    batches = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    paths = [b.toString() for b in batches if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(b, "_SUCCESS"))]
    df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return df.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; appends what was missing to the cache."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = broadcast_file(spark, tokenizer_path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    digests = materialize(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "count-digests")
    firsts = digests.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"))
    misses = firsts.join(read_cache(docs, cache, version), "digest", "left_anti")
    # by digest too: rows that share an id, or have none, may bring other texts
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = rows.join(misses.withColumnRenamed("digest", "d"), F.col("doc_id").eqNullSafe(F.col("rep")) & (digest == F.col("d"))).select("d", "text")

    def make():
        count = _counter(tokenizer_path, content.value)

        def run(b: pa.RecordBatch):
            got = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(count(list(got.values())), pa.int64())], ["digest", "n_tokens"])

        return run

    counted = map_arrow(texts, make, "digest binary, n_tokens long").select("digest", F.lit(version).alias("version"), "n_tokens")
    counted.write.parquet(f"{cache.rstrip('/')}/batch-{uuid.uuid4().hex}")
    return digests.join(read_cache(docs, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
