"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.ship import ship_package

#: ASCII white space, as all word rules of the operators take it: blank, tab, and 0x0A to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if not _local:
        _local = tempfile.mkdtemp(prefix="ebbtide-")
    return _local


_local = ""


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that materialize() gave back; nothing may read it, or what was derived from it lazily, any more."""
    remove_path(df.sparkSession, df._written)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def hash_unit(key: Column) -> Column:
    """A number in (0, 1) that only the string key decides: 52 bits of its MD5 digest, the same in any SQL engine that has md5()."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 marks held-out rows. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def py_fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def broadcast_file(spark: SparkSession, path: str):
    """A tokenizer's file as a broadcast variable (a few MB at most), so that executors need not have the path."""
    size = os.path.getsize(path)
    if size > 64 << 20:
        raise ValueError(f"{path} has {size} bytes; a vocabulary file is expected to be far smaller")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def fresh_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Slots of a sieve, and thereby the bound of what it broadcasts: SIEVE / 64 rows of two longs.
SIEVE = 1 << 22


def sift(df: DataFrame, keys: list[Column], others: DataFrame, other_keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Splits df into rows that surely share no keys with `others`, and those that may. Only the latter need a shuffle to be joined.

    A filter of fixed size: the hash of a row's keys marks a bit. The more rows `others` has, the fewer rows it sets apart; no row that
    could match is ever among those set apart."""
    word, bit, mask, place = (fresh_name(n, df, others) for n in ("sieve_word", "sieve_bit", "sieve_mask", "sieve_place"))
    slot = lambda ks: F.pmod(F.xxhash64(*ks), F.lit(SIEVE))
    marks = others.select(slot(other_keys).alias(place)).select(F.floor(F.col(place) / 64).alias(word), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias(bit))
    marks = marks.groupBy(word).agg(F.bit_or(bit).alias(mask))
    own = df.withColumn(place, slot(keys)).join(F.broadcast(marks), F.floor(F.col(place) / 64) == F.col(word), "left")
    hit = F.expr(f"coalesce(shiftright({mask}, cast({place} % 64 as int)) & 1L, 0L) = 1L")
    return own.filter(~hit).drop(place, word, mask), own.filter(hit).drop(place, word, mask)


def slices(b: pa.RecordBatch, text: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in its column `text`, one row at least."""
    size = np.cumsum([x or 0 for x in pc.binary_length(b.column(text)).to_pylist()])
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right")))
        yield b.slice(at, end - at)
        at = end


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on between tasks and would hold their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Gives back what the driver holds of steps that are over: Python's garbage first, as it keeps broadcasts and frames, then the JVM's, whose
    heap would stay as wide as its busiest moment made it. Each call is a full collection, so only for the ends of long steps."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow where make() is called once for each task and returns a function from a RecordBatch to one or an iterable of them."""

    def run(batches: Iterator) -> Iterator:
        f = make()
        try:
            for b in batches:
                if b.num_rows:
                    yield from f(b)
        finally:
            del f
            give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
