"""Deterministic change histories derived from plain tables: what the registered queries run over.

U: events as upserts of one row for each user, a snapshot a day. A: orders that are appended by month and some of which end three months later.
M: a literal log of 26 catalog operations with its metadata rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.tokens import token_text
from ebbtide.meta import SCHEMAS, Catalog, frame
from ebbtide.operators.dml import BEGIN, END, ROWID

#: M: for each snapshot the change map, as (key, value) pairs.
LOG = [
    [("schemas_created", "main")], [("schemas_created", "test_s")], [("tables_created", "main.t_main")], [("tables_created", "test_s.t_sub")], [("tables_inserted_into", "2")], [("inlined_insert", "2")], [("inlined_delete", "2")],
    [("tables_deleted_from", "2")], [("inlined_delete", "2")], [("tables_inserted_into", "2")], [("tables_created", "main.t_compact")], [("tables_inserted_into", "4")], [("tables_inserted_into", "4")], [("tables_inserted_into", "4")],
    [("merge_adjacent", "4")], [("tables_altered", "2")], [("tables_altered", "2")], [("tables_altered", "2")], [("tables_altered", "2")], [("tables_created", "main.renamed_main")], [("views_created", "main.v1")],
    [("views_created", "main.v1"), ("views_dropped", "5")], [("views_dropped", "6")], [("tables_dropped", "2")], [("tables_dropped", "3")], [("schemas_dropped", "1")],
]
#: M: metadata rows, in the order of SCHEMAS.
ROWS = {
    "schemas": [(0, "main", 0, None), (1, "test_s", 1, 25)],
    "tables": [(2, "t_main", 0, 2, 19), (2, "renamed_main", 0, 19, 23), (3, "t_sub", 1, 3, 24), (4, "t_compact", 0, 10, None)],
    "views": [(5, "v1", 0, "SELECT 1", "spark", None, 20, 21), (6, "v1", 0, "SELECT 2", "spark", "a,b", 21, 22)],
    "columns": [
        (2, 1, 1, "id", "INTEGER", True, None, None, 2, 18), (2, 1, 1, "id", "BIGINT", True, None, None, 18, 23), (2, 2, 2, "name", "VARCHAR", True, None, None, 2, 17), (2, 2, 2, "full_name", "VARCHAR", True, None, None, 17, 23),
        (2, 3, 3, "extra", "INTEGER", True, "7", None, 15, 16), (3, 1, 1, "id", "INTEGER", False, None, None, 3, 24), (3, 2, 2, "pair", "STRUCT", True, None, None, 3, 24), (3, 3, 3, "left", "INTEGER", True, None, 2, 3, 24), (4, 1, 1, "id", "INTEGER", True, None, None, 10, None),
    ],
    "schema_versions": [(2, 2), (3, 3), (4, 10), (2, 15), (2, 16), (2, 17), (2, 18)],
}
LOG_START = "2024-01-01 00:00:00"


def log_frames() -> dict[str, list[tuple]]:
    """All frames of M as rows; schema_version counts the snapshots with schema changes."""
    version, snapshot, changes = -1, [], []
    for i, pairs in enumerate(LOG):
        version += any(k.startswith(("schemas", "tables_created", "tables_altered", "tables_dropped", "views")) for k, _ in pairs)
        m: dict[str, list[str]] = {}
        for k, v in pairs:
            m.setdefault(k, []).append(v)
        snapshot.append((i, f"2024-01-{1 + i // 24:02} {i % 24:02}:00:00", version))
        changes.append((i, m, token_text(m), f"author{i % 3}", None, None))
    return {"snapshot": snapshot, "changes": changes, **ROWS}


def log_catalog(spark: SparkSession) -> Catalog:
    frames = log_frames()

    def of(name: str) -> DataFrame:
        df = frame(spark, frames[name], SCHEMAS[name].replace("timestamp", "string"))
        return df.withColumn("snapshot_time", F.to_timestamp("snapshot_time")) if name == "snapshot" else df

    return Catalog(*(of(n) for n in SCHEMAS))


def user_versions(events: DataFrame) -> DataFrame:
    """U as row versions: a user's last event of a day is the row from that day on; an error as the last event ends the row."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long") + 1
    per_day = Window.partitionBy("user_id", "day").orderBy(F.col("event_id").desc())
    last = events.filter("user_id is not null").select("user_id", "event_id", day.alias("day"), "event_type", "value").withColumn("n", F.row_number().over(per_day)).filter("n = 1")
    per_user = Window.partitionBy("user_id").orderBy("day")
    last = last.withColumn("next_day", F.lead("day").over(per_user))
    return last.filter("event_type <> 'error'").select(F.col("user_id").alias(ROWID), F.col("day").alias(BEGIN), F.col("next_day").alias(END), "event_type", "value")


def order_versions(orders: DataFrame) -> DataFrame:
    """A as row versions: an order begins with its month (1995-01 is 1); one of status F ends three months later."""
    month = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("long")
    return orders.select(F.col("o_orderkey").alias(ROWID), month.alias(BEGIN), F.when(F.col("o_orderstatus") == "F", month + 3).alias(END), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def commit_frames(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """snapshot and changes of n snapshots; every seventh has no metadata left."""
    base = spark.range(1, n + 1).filter("id % 7 <> 0")
    snapshot = base.select(F.col("id").alias("snapshot_id"), (F.to_timestamp(F.lit(LOG_START)) + F.make_dt_interval(F.col("id").cast("int"))).alias("snapshot_time"), F.lit(0).cast("long").alias("schema_version"))
    changes = base.select(F.col("id").alias("snapshot_id"), F.lit(None).cast("map<string,array<string>>").alias("changes"), F.lit(None).cast("string").alias("changes_made"), F.concat(F.lit("author"), (F.col("id") % 3).cast("string")).alias("author"), F.concat(F.lit("day "), F.col("id").cast("string")).alias("commit_message"), F.lit(None).cast("string").alias("commit_extra_info"))
    return snapshot, changes


def last_snapshot(*versions: DataFrame) -> int:
    """The greatest snapshot that a row begins or ends at; 1 where there is none."""
    return max([1, *(v.agg(F.max(F.greatest(BEGIN, END)).alias("n")).first().n or 1 for v in versions)])


def touched_catalog(spark: SparkSession, users: DataFrame, orders: DataFrame, n: int) -> Catalog:
    """A catalog whose change maps say which of the tables 1 (users) and 2 (orders) each snapshot wrote to or ended rows of."""
    parts = [versions.select(F.explode(F.array(F.struct(F.col(BEGIN).alias("s"), F.lit("tables_inserted_into").alias("k")), F.struct(F.col(END).alias("s"), F.lit("tables_deleted_from").alias("k")))).alias("x")).select("x.s", "x.k", F.lit(str(i)).alias("v")) for i, versions in enumerate((users, orders), 1)]
    tokens = parts[0].unionByName(parts[1]).filter("s is not null and s between 1 and " + str(n)).distinct()
    maps = tokens.groupBy("s", "k").agg(F.sort_array(F.collect_list("v")).alias("vs")).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "vs")))).alias("changes"))
    snapshot = spark.range(1, n + 1).select(F.col("id").alias("snapshot_id"), F.to_timestamp(F.lit(LOG_START)).alias("snapshot_time"), F.lit(0).cast("long").alias("schema_version"))
    changes = maps.select(F.col("s").alias("snapshot_id"), "changes", *[F.lit(None).cast("string").alias(c) for c in ("changes_made", "author", "commit_message", "commit_extra_info")])
    empty = {name: spark.createDataFrame([], SCHEMAS[name]) for name in SCHEMAS}
    return Catalog(**{**empty, "snapshot": snapshot, "changes": changes})
