"""Row-change feeds, ticks and time travel over row versions.

A row version has a row id, the snapshot that wrote it and the one that ended it (null: still there). Reads and feeds are filters on
those two numbers, so a range of snapshots prunes files by their min/max statistics; only a feed that must tell an update from a delete
beside an insert needs a shuffle, on (snapshot, row id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.tokens import DML_TOKENS, exploded, strict_id
from ebbtide.meta import Catalog

BEGIN, END, ROWID = "_begin", "_end", "_rowid"
CHANGE_TYPES = ("insert", "update_preimage", "update_postimage", "delete")
COMMIT_COLUMNS = ["snapshot_time", "author", "commit_message", "commit_extra_info"]


def read_at(versions: DataFrame, snapshot: int) -> DataFrame:
    """The rows that a table had at a snapshot."""
    return versions.filter((F.col(BEGIN) <= snapshot) & (F.col(END).isNull() | (F.col(END) > snapshot))).drop(BEGIN, END)


def change_feed(versions: DataFrame, lo: int, hi: int) -> DataFrame:
    """snapshot_id, rowid, change_type and the table's columns for snapshots lo to hi, both included.

    A row id that one snapshot both ends and writes is an update: its old version is the preimage, its new one the postimage."""
    cols = [c for c in versions.columns if c not in (BEGIN, END, ROWID)]
    # both sides read only row versions that begin or end in the range
    touched = versions.filter(F.col(BEGIN).between(lo, hi) | F.col(END).between(lo, hi))
    both = F.array(
        F.when(F.col(BEGIN).between(lo, hi) & (F.col(END).isNull() | (F.col(END) != F.col(BEGIN))), F.struct(F.col(BEGIN).alias("snapshot_id"), F.lit(1).alias("written"))),
        F.when(F.col(END).between(lo, hi) & (F.col(END) != F.col(BEGIN)), F.struct(F.col(END).alias("snapshot_id"), F.lit(0).alias("written"))),
    )
    rows = touched.select(F.explode(F.array_compact(both)).alias("at"), F.col(ROWID).alias("rowid"), *cols).select("at.snapshot_id", "rowid", "at.written", *cols)
    return _typed(rows, cols)


def _typed(rows: DataFrame, cols: list[str]) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("snapshot_id", "rowid"))
    kind = F.when(n > 1, F.when(F.col("written") == 1, "update_postimage").otherwise("update_preimage")).otherwise(F.when(F.col("written") == 1, "insert").otherwise("delete"))
    return rows.select("snapshot_id", "rowid", kind.alias("change_type"), *cols)


def pair_changes(written: DataFrame, ended: DataFrame) -> DataFrame:
    """A feed from the rows that a range wrote and those that it ended (with END)."""
    cols = [c for c in written.columns if c not in (BEGIN, END, ROWID)]
    new = written.select(F.col(BEGIN).alias("snapshot_id"), F.col(ROWID).alias("rowid"), F.lit(1).alias("written"), *cols)
    old = ended.select(F.col(END).alias("snapshot_id"), F.col(ROWID).alias("rowid"), F.lit(0).alias("written"), *cols)
    return _typed(new.unionByName(old), cols)


def with_commits(changes: DataFrame, catalog: Catalog) -> DataFrame:
    """changes with the time, author and messages of their snapshots (a small side: one row for each snapshot)."""
    meta = catalog.snapshot.join(catalog.changes, "snapshot_id", "left").select("snapshot_id", *COMMIT_COLUMNS)
    return changes.join(meta, "snapshot_id", "left").select(*changes.columns, *COMMIT_COLUMNS)


def ordered(changes: DataFrame) -> DataFrame:
    """By snapshot and row, a preimage before its postimage."""
    return changes.orderBy("snapshot_id", "rowid", F.when(F.col("change_type") == "update_postimage", 1).otherwise(0))


def of_types(changes: DataFrame, types: list[str]) -> DataFrame:
    unknown = set(types) - {*CHANGE_TYPES, "*"}
    if unknown:
        raise ValueError(f"unknown change types: {sorted(unknown)}")
    return changes if "*" in types else changes.filter(F.col("change_type").isin(*types))


def dml_tokens(catalog: Catalog, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """snapshot_id, table_id: which tables' rows each snapshot touches."""
    c = catalog.changes
    if lo is not None:
        c = c.filter(F.col("snapshot_id") >= lo)
    if hi is not None:
        c = c.filter(F.col("snapshot_id") <= hi)
    return exploded(c, DML_TOKENS).select("snapshot_id", strict_id(F.col("value")).alias("table_id")).filter("table_id is not null").distinct()


def dml_ticks(catalog: Catalog, lo: int, hi: int, table_ids: list[int] | None = None) -> DataFrame:
    """One row for each snapshot that touches rows (of these tables)."""
    t = dml_tokens(catalog, lo, hi)
    if table_ids is not None:
        t = t.filter(F.col("table_id").isin(*table_ids)) if table_ids else t.limit(0)
    t = t.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("table_id")).alias("table_ids"))
    return catalog.snapshot.join(t, "snapshot_id").select("snapshot_id", "snapshot_time", "schema_version", "table_ids").orderBy("snapshot_id")
