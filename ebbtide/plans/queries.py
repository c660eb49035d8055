"""The registered queries over the scenarios, each through the operators, and the same answers in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.tokens import DDL_TOKENS, DML_TOKENS, exploded
from ebbtide.meta import alive_at
from ebbtide.operators import ddl, dml
from ebbtide.operators.dml import BEGIN, END, ROWID
from ebbtide.plans import scenarios
from ebbtide.sources.lake import Lake
from ebbtide.streaming.cdc import Cdc, dml_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.user_versions(_table(spark, sf_dir, "events"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.order_versions(_table(spark, sf_dir, "orders"))


_clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)

# ---- row feeds -----------------------------------------------------------------------------------------------------------

USERS_SQL = """
    last AS (SELECT user_id, event_type, value, day FROM (
        SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS day, row_number() OVER (PARTITION BY user_id, date_diff('day', DATE '2024-01-01', ts::DATE) ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1),
    steps AS (SELECT *, lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_value FROM last WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    feed AS (
        SELECT day AS snapshot_id, user_id AS rowid, CASE WHEN old_type IS NULL OR old_type = 'error' THEN 'insert' ELSE 'update_postimage' END AS change_type, event_type, value FROM steps WHERE event_type <> 'error'
        UNION ALL SELECT day, user_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update_preimage' END, old_type, old_value FROM steps WHERE old_type <> 'error')"""
ORDERS_SQL = """
    v AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS b, CASE WHEN o_orderstatus = 'F' THEN (year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 3 END AS e FROM orders)"""


@query(f"WITH {USERS_SQL} SELECT snapshot_id, rowid, change_type, event_type, value FROM feed WHERE snapshot_id BETWEEN 5 AND 20")
def dml_changes_query(spark, sf_dir):
    return dml.ordered(dml.change_feed(_users(spark, sf_dir), 5, 20))


@query(f"WITH {USERS_SQL} SELECT snapshot_id, rowid, change_type, event_type, value FROM feed WHERE change_type IN ('insert', 'delete')")
def dml_changes_query_types(spark, sf_dir):
    return dml.of_types(dml.change_feed(_users(spark, sf_dir), 1, 10_000), ["insert", "delete"])


@query(f"""WITH {USERS_SQL} SELECT f.snapshot_id, rowid, change_type, event_type, value,
    CASE WHEN f.snapshot_id % 7 <> 0 THEN strftime(TIMESTAMP '{scenarios.LOG_START}' + to_days(f.snapshot_id::INT), '%Y-%m-%d %H:%M:%S') END AS snapshot_time,
    CASE WHEN f.snapshot_id % 7 <> 0 THEN 'author' || (f.snapshot_id % 3) END AS author, CASE WHEN f.snapshot_id % 7 <> 0 THEN 'day ' || f.snapshot_id END AS commit_message, NULL::VARCHAR AS commit_extra_info FROM feed f""")
def dml_changes_commit_meta(spark, sf_dir):
    c = scenarios.log_catalog(spark)
    c.snapshot, c.changes = scenarios.commit_frames(spark, 60)
    return dml.with_commits(dml.change_feed(_users(spark, sf_dir), 1, 10_000), c).withColumn("snapshot_time", _clock("snapshot_time"))


@query(f"WITH {USERS_SQL} SELECT change_type, event_type, count(*) AS n, count(DISTINCT rowid) AS n_rows FROM feed GROUP BY ALL")
def events_by_change_type(spark, sf_dir):
    return dml.change_feed(_users(spark, sf_dir), 1, 10_000).groupBy("change_type", "event_type").agg(F.count("*").alias("n"), F.countDistinct("rowid").alias("n_rows"))


@query(f"""WITH {ORDERS_SQL} SELECT b AS snapshot_id, o_orderkey AS rowid, 'insert' AS change_type, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM v WHERE b BETWEEN 10 AND 20
    UNION ALL SELECT e, o_orderkey, 'delete', o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM v WHERE e BETWEEN 10 AND 20""")
def append_delete_feed(spark, sf_dir):
    return dml.change_feed(_orders(spark, sf_dir).drop("o_orderdate"), 10, 20)


@query(f"WITH {ORDERS_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM v WHERE b <= 15 AND (e IS NULL OR e > 15)")
def time_travel_read(spark, sf_dir):
    return dml.read_at(_orders(spark, sf_dir), 15).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS surplus")
def snapshot_roundtrip(spark, sf_dir):
    """read_at(20) against read_at(9) with the feed of 10 to 20 applied, in both directions."""
    v = _orders(spark, sf_dir)
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    feed = dml.change_feed(v, 10, 20)
    gone = feed.filter("change_type in ('delete', 'update_preimage')")
    made = dml.read_at(v, 9).select(cols).unionByName(feed.filter("change_type in ('insert', 'update_postimage')").select(cols)).exceptAll(gone.select(cols))
    full = dml.read_at(v, 20).select(cols)
    return full.exceptAll(made).agg(F.count("*").alias("missing")).crossJoin(made.exceptAll(full).agg(F.count("*").alias("surplus")))


@query(f"WITH {ORDERS_SQL} SELECT o_custkey, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM v WHERE b <= 20 AND (e IS NULL OR e > 20) GROUP BY o_custkey")
def revenue_incremental(spark, sf_dir):
    """A view kept by signed contributions of the feed, without a rescan of the table's state."""
    sign = F.when(F.col("change_type").isin("insert", "update_postimage"), 1).otherwise(-1)
    feed = dml.change_feed(_orders(spark, sf_dir), 1, 20).withColumn("sign", sign)
    view = feed.groupBy("o_custkey").agg(F.sum("sign").alias("orders"), F.sum(F.col("sign") * F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return view.filter("orders <> 0")


@query(f"""WITH {ORDERS_SQL}, top AS (SELECT l_orderkey, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, b AS snapshot_id, top_price FROM v LEFT JOIN top ON l_orderkey = o_orderkey WHERE b BETWEEN 30 AND 40""")
def snapshot_lookup_join(spark, sf_dir):
    """Driver changes with a looked-up value of another table."""
    top = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top_price"))
    inserts = dml.of_types(dml.change_feed(_orders(spark, sf_dir), 30, 40), ["insert"])
    return inserts.join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "snapshot_id", "top_price")


TOKENS_SQL = f"""{USERS_SQL}, {ORDERS_SQL},
    uv AS (SELECT user_id, day AS b, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS e, event_type FROM last),
    all_touched AS (SELECT DISTINCT s, t FROM (SELECT b AS s, 1 AS t FROM uv WHERE event_type <> 'error' UNION ALL SELECT e, 1 FROM uv WHERE event_type <> 'error' UNION ALL SELECT b, 2 FROM v UNION ALL SELECT e, 2 FROM v) WHERE s >= 1),
    touched AS (SELECT * FROM all_touched WHERE s <= 60)"""


@query(f"WITH {TOKENS_SQL} SELECT s AS snapshot_id, 0::BIGINT AS schema_version, string_agg(t::VARCHAR, ',' ORDER BY t) AS table_ids FROM all_touched GROUP BY s")
def dml_ticks_query(spark, sf_dir):
    """All snapshots of the history, up to the last that a row begins or ends at."""
    users, orders = _users(spark, sf_dir), _orders(spark, sf_dir)
    head = scenarios.last_snapshot(users, orders)
    return dml.dml_ticks(scenarios.touched_catalog(spark, users, orders, head), 1, head).select("snapshot_id", "schema_version", F.array_join(F.col("table_ids").cast("array<string>"), ",").alias("table_ids"))


@query(f"WITH {TOKENS_SQL} SELECT s AS snapshot_id, '1' AS table_ids FROM touched WHERE t = 1 AND s BETWEEN 3 AND 25")
def dml_ticks_filtered(spark, sf_dir):
    c = scenarios.touched_catalog(spark, _users(spark, sf_dir), _orders(spark, sf_dir), 60)
    return dml.dml_ticks(c, 3, 25, [1]).select("snapshot_id", F.array_join(F.col("table_ids").cast("array<string>"), ",").alias("table_ids"))


@query("""WITH gaps AS (SELECT value AS ms FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM gaps), o AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i FROM gaps)
    SELECT max(CASE WHEN i = floor((n - 1) * 0.5) THEN ms END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95) THEN ms END) AS p95, max(CASE WHEN i = floor((n - 1) * 0.99) THEN ms END) AS p99 FROM o, n""")
def latency_percentiles(spark, sf_dir):
    """Lower nearest-rank percentiles."""
    v = _table(spark, sf_dir, "events").filter("value is not null")
    counts = v.groupBy("value").count()
    from pyspark.sql import Window

    upto = F.sum("count").over(Window.orderBy("value"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    ranked = counts.withColumn("upto", upto).withColumn("n", total)
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q), F.col("value"))).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


@query("SELECT CASE WHEN value < 10 THEN '<10' WHEN value < 50 THEN '<50' WHEN value < 100 THEN '<100' ELSE '>=100' END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(spark, sf_dir):
    b = F.when(F.col("value") < 10, "<10").when(F.col("value") < 50, "<50").when(F.col("value") < 100, "<100").otherwise(">=100")
    return _table(spark, sf_dir, "events").filter("value is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


# ---- windows -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {TOKENS_SQL}, cursors AS (SELECT unnest(range(0, 60, 5)) AS c), f AS (
        SELECT c, (SELECT min(s) FROM touched WHERE t = 1 AND s > c) AS first, CASE WHEN c < 17 THEN 17 END AS boundary FROM cursors)
    SELECT c AS last_committed, CASE WHEN boundary IS NOT NULL AND (first IS NULL OR boundary <= first) THEN boundary WHEN first IS NULL THEN c + 1 ELSE first END AS start_snapshot,
        CASE WHEN boundary IS NOT NULL AND (first IS NULL OR boundary <= first) THEN boundary - 1 WHEN first IS NULL THEN c WHEN boundary <= least(60, first + 7) THEN boundary - 1 ELSE least(60, first + 7) END AS end_snapshot,
        first IS NOT NULL AND (boundary IS NULL OR boundary > first) AS has_changes, boundary IS NOT NULL AND (first IS NULL OR boundary <= first) AS terminal, coalesce(boundary <= least(60, first + 7), boundary IS NOT NULL) AS schema_changes_pending,
        CASE WHEN first IS NULL OR boundary <= first OR boundary <= least(60, first + 7) THEN boundary END AS terminal_at_snapshot FROM (SELECT c, first, boundary FROM f) AS f""")
def dml_windows(spark, sf_dir):
    """The windows of consumers at twelve cursors, eight snapshots each, with a shape change at snapshot 17."""
    c = scenarios.touched_catalog(spark, _users(spark, sf_dir), _orders(spark, sf_dir), 60)
    touched = sorted(r.snapshot_id for r in dml.dml_tokens(c, 1, 60).filter("table_id = 1").select("snapshot_id").distinct().collect())  # at most 60
    rows = []
    for cursor in range(0, 60, 5):
        w = dml_window(cursor, 60, 8, next((s for s in touched if s > cursor), None), 17 if cursor < 17 else None)
        rows.append((cursor, w[0], w[1], w[2], w[3], w[4], w[5]))
    return spark.createDataFrame(rows, "last_committed long, start_snapshot long, end_snapshot long, has_changes boolean, schema_changes_pending boolean, terminal boolean, terminal_at_snapshot long")


# ---- the catalog log -----------------------------------------------------------------------------------------------------


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns}))"


def _log_sql() -> str:
    f = scenarios.log_frames()
    pairs = [(i, k, v, n) for i, p in enumerate(scenarios.LOG) for n, (k, v) in enumerate(p)]
    b, e = "begin_snapshot", "end_snapshot"
    return f"""
    snapshot AS {_values(f["snapshot"], "snapshot_id, snapshot_time, schema_version")}, made AS {_values([(r[0], r[2]) for r in f["changes"]], "snapshot_id, changes_made")}, pairs AS {_values(pairs, "snapshot_id, key, value, place")},
    schemas AS {_values(f["schemas"], f"schema_id, schema_name, {b}, {e}")}, tables AS {_values(f["tables"], f"table_id, table_name, schema_id, {b}, {e}")},
    views AS {_values(f["views"], f"view_id, view_name, schema_id, sql, dialect, column_aliases, {b}, {e}")}, cols AS {_values(f["columns"], f"table_id, column_id, column_order, name, type, nullable, dflt, parent, {b}, {e}")},
    versions AS {_values(f["schema_versions"], f"table_id, {b}")},
    named AS (SELECT 'table' AS k, table_id AS oid, table_name AS oname, schema_id, {b}, {e} FROM tables UNION ALL SELECT 'view', view_id, view_name, schema_id, {b}, {e} FROM views),
    obj AS (SELECT n.*, schema_name, s.{b} AS sb, s.{e} AS se FROM named n JOIN schemas s USING (schema_id)),
    d AS (SELECT *, CASE WHEN key LIKE '%created' THEN 'created' WHEN key LIKE '%altered' THEN 'altered' ELSE 'dropped' END AS ev, CASE WHEN key LIKE 'schemas%' THEN 'schema' WHEN key LIKE 'views%' THEN 'view' ELSE 'table' END AS ok,
            snapshot_id - (key LIKE '%dropped')::INT AS held_at, try_cast(value AS BIGINT) AS vid FROM pairs WHERE regexp_matches(key, '^(schemas|views)|tables_(created|altered|dropped)')),
    ev0 AS (
        SELECT d.snapshot_id, ev, ok, s.schema_id, s.schema_name, s.schema_id AS oid, s.schema_name AS oname FROM d JOIN schemas s ON ok = 'schema' AND CASE WHEN ev = 'created' THEN s.schema_name = value AND s.{b} = d.snapshot_id ELSE s.schema_id = vid AND s.{b} <= held_at AND (s.{e} IS NULL OR s.{e} > held_at) END
        UNION ALL SELECT d.snapshot_id, ev, ok, o.schema_id, o.schema_name, o.oid, o.oname FROM d JOIN obj o ON ok = o.k AND CASE WHEN ev = 'created' THEN o.schema_name || '.' || o.oname = value AND o.{b} = d.snapshot_id ELSE o.oid = vid AND o.{b} <= held_at AND (o.{e} IS NULL OR o.{e} > held_at) END),
    ev1 AS (SELECT x.*, (SELECT arg_max(table_name, {b}) FROM tables t WHERE x.ok = 'table' AND x.ev = 'created' AND t.table_id = x.oid AND t.{b} < x.snapshot_id) AS old_name FROM ev0 x),
    ev2 AS (SELECT * EXCLUDE (ev), CASE WHEN old_name IS NOT NULL AND old_name <> oname THEN 'altered' ELSE ev END AS ev FROM ev1),
    pairs_at AS (SELECT v.{b} AS s, v.table_id, coalesce(o.column_id, n.column_id) AS cid, o.column_id AS oc, n.column_id AS nc, o.name AS oname_, n.name AS nname, o.type AS otype, n.type AS ntype, o.dflt AS od, n.dflt AS nd, o.nullable AS onull, n.nullable AS nnull, o.parent AS op, n.parent AS np
        FROM versions v, (SELECT DISTINCT table_id AS tid, column_id AS c FROM cols) a LEFT JOIN cols o ON o.table_id = tid AND o.column_id = c AND o.{b} <= v.{b} - 1 AND (o.{e} IS NULL OR o.{e} > v.{b} - 1)
        LEFT JOIN cols n ON n.table_id = tid AND n.column_id = c AND n.{b} <= v.{b} AND (n.{e} IS NULL OR n.{e} > v.{b}) WHERE tid = v.table_id AND (o.column_id IS NOT NULL OR n.column_id IS NOT NULL)),
    diffs AS (
        SELECT *, 'added' AS kind, 1 AS rk FROM pairs_at WHERE oc IS NULL UNION ALL SELECT *, 'dropped', 2 FROM pairs_at WHERE nc IS NULL UNION ALL SELECT *, 'renamed', 3 FROM pairs_at WHERE oname_ <> nname
        UNION ALL SELECT *, 'type_changed', 4 FROM pairs_at WHERE otype <> ntype UNION ALL SELECT *, 'default_changed', 5 FROM pairs_at WHERE oc IS NOT NULL AND nc IS NOT NULL AND od IS DISTINCT FROM nd UNION ALL SELECT *, 'nullable_changed', 6 FROM pairs_at WHERE onull <> nnull),
    items AS (SELECT s, table_id, kind, rk, cid, CASE kind WHEN 'added' THEN '{{"id":' || cid || ',"name":"' || nname || '","type":"' || ntype || '","nullable":' || nnull || ',"default":' || coalesce('"' || nd || '"', 'null') || '}}'
        WHEN 'dropped' THEN '{{"id":' || cid || ',"name":"' || oname_ || '","type":"' || otype || '","nullable":' || onull || ',"default":' || coalesce('"' || od || '"', 'null') || '}}'
        WHEN 'renamed' THEN '{{"id":' || cid || ',"old_name":"' || oname_ || '","new_name":"' || nname || '"}}' WHEN 'type_changed' THEN '{{"id":' || cid || ',"name":"' || nname || '","old_type":"' || otype || '","new_type":"' || ntype || '"}}' ELSE '{{}}' END AS item FROM diffs),
    texts AS (SELECT s, table_id, string_agg(t, ',' ORDER BY rk) AS diff FROM (SELECT s, table_id, rk, '"' || kind || '":[' || string_agg(item, ',' ORDER BY cid) || ']' AS t FROM items GROUP BY s, table_id, rk, kind) GROUP BY s, table_id),
    made_of AS (SELECT x.snapshot_id AS s, x.oid AS t, '{{"columns":[' || string_agg('{{"id":' || column_id || ',"order":' || column_order || ',"name":"' || name || '","type":"' || type || '","nullable":' || nullable || ',"default":' || coalesce('"' || dflt || '"', 'null') || coalesce(',"parent_column_id":' || parent, '') || '}}', ',' ORDER BY column_order) || ']}}' AS made_text
        FROM ev2 x JOIN cols c ON x.ok = 'table' AND x.ev = 'created' AND c.table_id = x.oid AND c.{b} <= x.snapshot_id AND (c.{e} IS NULL OR c.{e} > x.snapshot_id) GROUP BY ALL),
    ddl AS (SELECT x.snapshot_id, snapshot_time, ev AS event_kind, ok AS object_kind, x.schema_id, x.schema_name, x.oid AS object_id, x.oname AS object_name,
        CASE WHEN ok = 'table' AND ev = 'created' THEN made_text WHEN ok = 'table' AND ev = 'altered' THEN '{{' || concat_ws(',', CASE WHEN old_name IS NOT NULL THEN '"old_table_name":"' || old_name || '","new_table_name":"' || x.oname || '"' END, diff) || '}}'
            WHEN ok = 'view' AND ev = 'created' THEN (SELECT '{{"definition":"' || sql || '","dialect":"' || dialect || '","column_aliases":' || coalesce('"' || column_aliases || '"', 'null') || '}}' FROM views w WHERE w.view_id = x.oid) ELSE '{{}}' END AS details
        FROM ev2 x JOIN snapshot USING (snapshot_id) LEFT JOIN made_of m ON m.s = x.snapshot_id AND m.t = x.oid AND ok = 'table' LEFT JOIN texts z ON z.s = x.snapshot_id AND z.table_id = x.oid AND ok = 'table')"""


LOG_SQL = _log_sql()


def _events(spark: SparkSession) -> DataFrame:
    return ddl.ddl_events(scenarios.log_catalog(spark), 0, len(scenarios.LOG) - 1)


@query(f"WITH {LOG_SQL} SELECT * FROM ddl")
def ddl_changes_query(spark, sf_dir):
    return _events(spark).orderBy("snapshot_id", "place").select(*ddl.EVENT_COLUMNS).withColumn("snapshot_time", _clock("snapshot_time"))


@query(f"WITH {LOG_SQL} SELECT snapshot_id, event_kind, object_kind, object_name FROM ddl WHERE schema_id = 1 OR (object_kind = 'table' AND object_id = 4)")
def ddl_changes_filtered(spark, sf_dir):
    return ddl.filter_events(_events(spark), [1], [4]).select("snapshot_id", "event_kind", "object_kind", "object_name")


@query(f"""WITH {LOG_SQL} SELECT snapshot_id, s.snapshot_time, schema_version, changes_made, string_agg(DISTINCT schema_id::VARCHAR, ',' ORDER BY schema_id::VARCHAR) AS schema_ids,
    coalesce(string_agg(DISTINCT CASE WHEN object_kind = 'table' THEN object_id::VARCHAR END, ','), '') AS table_ids, count(*) AS change_count FROM ddl JOIN snapshot s USING (snapshot_id) JOIN made USING (snapshot_id) GROUP BY snapshot_id, s.snapshot_time, schema_version, changes_made""")
def ddl_ticks_query(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return ddl.ddl_ticks(scenarios.log_catalog(spark), _events(spark)).select("snapshot_id", _clock("snapshot_time"), "schema_version", "changes_made", text("schema_ids"), text("table_ids"), "change_count")


@query(f"""WITH {LOG_SQL} SELECT s AS snapshot_id, snapshot_time, kind AS change_kind, cid AS column_id, CASE WHEN kind <> 'added' THEN oname_ END AS old_name, CASE WHEN kind <> 'dropped' THEN nname END AS new_name,
    CASE WHEN kind IN ('dropped', 'type_changed') THEN otype END AS old_type, CASE WHEN kind IN ('added', 'type_changed') THEN ntype END AS new_type, CASE WHEN kind IN ('dropped', 'default_changed') THEN od END AS old_default,
    CASE WHEN kind IN ('added', 'default_changed') THEN nd END AS new_default, CASE WHEN kind IN ('dropped', 'nullable_changed') THEN onull END AS old_nullable, CASE WHEN kind IN ('added', 'nullable_changed') THEN nnull END AS new_nullable, NULL::BIGINT AS parent_column_id
    FROM diffs JOIN snapshot ON snapshot_id = s WHERE table_id = 2
    UNION ALL SELECT 19, (SELECT snapshot_time FROM snapshot WHERE snapshot_id = 19), 'table_rename', NULL, 't_main', 'renamed_main', NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def schema_diff(spark, sf_dir):
    return ddl.schema_diff(scenarios.log_catalog(spark), "t_main", 0, 25).withColumn("snapshot_time", _clock("snapshot_time"))


@query(f"WITH {LOG_SQL} SELECT snapshot_id, key, value, CASE WHEN regexp_matches(key, '^(schemas|views)|tables_(created|altered|dropped)') THEN 'ddl' WHEN key = 'merge_adjacent' THEN 'other' ELSE 'dml' END AS category FROM pairs")
def token_decode(spark, sf_dir):
    category = F.when(F.col("key").isin(*DDL_TOKENS), "ddl").when(F.col("key").isin(*DML_TOKENS), "dml").otherwise("other")
    return exploded(scenarios.log_catalog(spark).changes).select("snapshot_id", "key", "value", category.alias("category"))


@query(f"WITH {LOG_SQL} SELECT snapshot_id, oid AS object_id, k AS object_kind, schema_name || '.' || oname AS qualified_name FROM snapshot JOIN obj o ON o.begin_snapshot <= snapshot_id AND (o.end_snapshot IS NULL OR o.end_snapshot > snapshot_id)")
def objects_at_each_snapshot(spark, sf_dir):
    c = scenarios.log_catalog(spark)
    return c.snapshot.select("snapshot_id").join(ddl._objects(c), alive_at(F.col("snapshot_id"))).select("snapshot_id", "object_id", F.col("kind").alias("object_kind"), F.concat("schema_name", F.lit("."), "object_name").alias("qualified_name"))


# ---- consumers on a lake -------------------------------------------------------------------------------------------------

START = datetime(2024, 6, 1, tzinfo=timezone.utc)
_demo: dict[tuple[str, str], tuple[Cdc, Lake]] = {}


def demo(spark: SparkSession, sf_dir: str) -> tuple[Cdc, Lake]:
    """A lake of twelve snapshots over `nation`, an hour apart, with consumers; made once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _demo:
        return _demo[key]
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="ebbtide-lake-")
    lake = Lake(spark, f"{root.rstrip('/')}/lake-{uuid.uuid4().hex}")
    cdc = Cdc(spark, clock=lambda: (START + timedelta(hours=24)).timestamp()).attach(lake)
    at = lambda n: START + timedelta(hours=n)
    lake.create_table("nations", "n_nationkey int, n_name string, n_regionkey int", at=at(1))
    cdc.cdc_dml_consumer_create(lake.name, "mirror", table_name="nations")
    cdc.cdc_ddl_consumer_create(lake.name, "watch", start_at="beginning")
    cdc.cdc_dml_consumer_create(lake.name, "wake", start_at="beginning")
    lake.insert("nations", _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey"), at=at(2), author="loader", message="seed")
    lake.update("nations", {"n_name": "concat(n_name, '!')"}, "n_regionkey = 1", at=at(3))
    lake.delete("nations", "n_regionkey = 3", at=at(4))
    lake.create_schema("aux", at=at(5))
    lake.create_table("aux.notes", "id int", at=at(6))
    cdc.cdc_dml_consumer_create(lake.name, "notes", table_name="aux.notes", change_types=["insert"])
    lake.insert("aux.notes", [(1,), (2,)], at=at(7))
    lake.add_column("nations", "score", "int", default="5", at=at(8))
    lake.insert("nations", [(100, "NEWLAND", 0, 9)], at=at(9))
    lake.rename_table("aux.notes", "remarks", at=at(10))
    lake.create_view("v", "select 1", at=at(11))
    _demo[key] = cdc, lake
    return _demo[key]


NATIONS_SQL = """
    n AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS rowid FROM nation),
    feed AS (SELECT 2 AS snapshot_id, rowid, 'insert' AS change_type, n_nationkey, n_name, n_regionkey FROM n
        UNION ALL SELECT 3, rowid, 'update_preimage', n_nationkey, n_name, n_regionkey FROM n WHERE n_regionkey = 1 UNION ALL SELECT 3, rowid, 'update_postimage', n_nationkey, n_name || '!', n_regionkey FROM n WHERE n_regionkey = 1
        UNION ALL SELECT 4, rowid, 'delete', n_nationkey, n_name, n_regionkey FROM n WHERE n_regionkey = 3)"""
_hour = "strftime(TIMESTAMP '2024-06-01' + to_hours(snapshot_id), '%Y-%m-%d %H:%M:%S')"


@query(f"WITH {NATIONS_SQL} SELECT snapshot_id, rowid, change_type, n_nationkey, n_name, n_regionkey, 5 AS score, {_hour} AS snapshot_time, CASE WHEN snapshot_id = 2 THEN 'loader' END AS author, CASE WHEN snapshot_id = 2 THEN 'seed' END AS commit_message FROM feed UNION ALL SELECT 9, 25, 'insert', 100, 'NEWLAND', 0, 9, '2024-06-01 09:00:00', NULL, NULL")
def lake_dml_changes_query(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_dml_changes_query(lake.name, 0, table_name="nations").drop("commit_extra_info").withColumn("snapshot_time", _clock("snapshot_time"))


@query(f"WITH {NATIONS_SQL} SELECT 'mirror' AS consumer_name, 2 AS start_snapshot, 7 AS end_snapshot, snapshot_id, rowid, change_type, 1 AS table_id, 'main.nations' AS table_name, n_nationkey, n_name, n_regionkey FROM feed")
def lake_dml_changes_read(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_dml_changes_read(lake.name, "mirror").drop("snapshot_time", "author", "commit_message", "commit_extra_info")


@query("SELECT * FROM (VALUES ('wake', 2, 11, 2, '1'), ('wake', 2, 11, 3, '1'), ('wake', 2, 11, 4, '1'), ('wake', 2, 11, 7, '3'), ('wake', 2, 11, 9, '1')) AS t(consumer_name, start_snapshot, end_snapshot, snapshot_id, table_ids)")
def lake_dml_ticks_listen(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_dml_ticks_listen(lake.name, "wake", timeout_ms=0).select("consumer_name", "start_snapshot", "end_snapshot", "snapshot_id", F.array_join(F.col("table_ids").cast("array<string>"), ",").alias("table_ids"))


@query("SELECT 'watch' AS consumer_name, * FROM (VALUES (1, 'created', 'table', 'nations'), (5, 'created', 'schema', 'aux'), (6, 'created', 'table', 'notes'), (8, 'altered', 'table', 'nations'), (10, 'altered', 'table', 'remarks'), (11, 'created', 'view', 'v')) AS t(snapshot_id, event_kind, object_kind, object_name)")
def lake_ddl_changes_listen(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_ddl_changes_listen(lake.name, "watch", timeout_ms=0).select("consumer_name", "snapshot_id", "event_kind", "object_kind", "object_name")


@query("SELECT * FROM (VALUES ('mirror', 2, 7, true, true, false, 8), ('notes', 7, 11, true, false, false, NULL), ('wake', 2, 11, true, false, false, NULL), ('watch', 1, 11, true, true, false, NULL)) AS t(consumer_name, start_snapshot, end_snapshot, has_changes, schema_changes_pending, terminal, terminal_at_snapshot)")
def lake_windows(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    out = None
    for n in ("mirror", "notes", "wake", "watch"):
        w = cdc.cdc_window(lake.name, n).drop("schema_version").withColumn("consumer_name", F.lit(n))
        out = w if out is None else out.unionByName(w)
    return out


@query("""SELECT * FROM (VALUES ('mirror', 'dml', 1, 'main.nations', 4, 4, 0, 0, 1, 8), ('notes', 'dml', 3, 'aux.remarks', 1, 0, 1, 0, 6, NULL), ('wake', 'dml', NULL, NULL, 4, 4, 0, 0, 0, NULL), ('watch', 'ddl', NULL, NULL, 1, 1, 0, 0, 0, NULL))
    AS t(consumer_name, consumer_kind, table_id, table_name, subscription_count, subscriptions_active, subscriptions_renamed, subscriptions_dropped, last_committed_snapshot, terminal_at_snapshot)""")
def lake_list_consumers(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_list_consumers(lake.name).select("consumer_name", "consumer_kind", "table_id", "table_name", "subscription_count", "subscriptions_active", "subscriptions_renamed", "subscriptions_dropped", "last_committed_snapshot", "terminal_at_snapshot")


@query("""SELECT consumer_name, scope_kind, table_id, change_type, original_qualified_name, current_qualified_name, status FROM (VALUES ('mirror', 'table', 1, 'main.nations', 'main.nations', 'active'), ('wake', 'catalog', NULL, NULL, NULL, 'active')) AS t(consumer_name, scope_kind, table_id, original_qualified_name, current_qualified_name, status),
        (VALUES ('insert'), ('update_preimage'), ('update_postimage'), ('delete')) AS c(change_type)
    UNION ALL SELECT * FROM (VALUES ('notes', 'table', 3, 'insert', 'aux.notes', 'aux.remarks', 'renamed'), ('watch', 'catalog', NULL, '*', NULL, NULL, 'active')) AS t""")
def lake_list_subscriptions(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_list_subscriptions(lake.name).select("consumer_name", "scope_kind", "table_id", "change_type", "original_qualified_name", "current_qualified_name", "status")


@query("""SELECT * FROM (VALUES ('mirror', 1, 11, 10, 82800.0, 0, 1), ('notes', 6, 11, 5, 64800.0, 0, 6)) AS t(consumer_name, last_committed_snapshot, current_snapshot, lag_snapshots, lag_seconds, oldest_available_snapshot, gap_distance)""")
def lake_consumer_stats(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    s = cdc.cdc_consumer_stats(lake.name).filter("consumer_name in ('mirror', 'notes')")
    return s.select("consumer_name", "last_committed_snapshot", "current_snapshot", "lag_snapshots", "lag_seconds", "oldest_available_snapshot", "gap_distance")


@query("""SELECT * FROM (VALUES ('info', 'CDC_METADATA_OK', NULL, NULL), ('warning', 'CDC_CONSUMER_LAG', 'mirror', '{"lag_snapshots":10}'), ('warning', 'CDC_SCHEMA_BOUNDARY', 'mirror', NULL), ('warning', 'CDC_CONSUMER_LAG', 'notes', '{"lag_snapshots":5}'),
    ('warning', 'CDC_SUBSCRIPTION_RENAMED', 'notes', '{"subscription_id":1}'), ('warning', 'CDC_CONSUMER_LAG', 'wake', '{"lag_snapshots":11}'), ('warning', 'CDC_CONSUMER_LAG', 'watch', '{"lag_snapshots":11}')) AS t(severity, code, consumer_name, details)""")
def lake_doctor(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_doctor(lake.name).filter("code not like 'CDC_LEASE%'").select("severity", "code", "consumer_name", "details")


@query("SELECT action, consumer_name, consumer_id FROM (VALUES ('consumer_create', 'mirror', 1), ('consumer_create', 'watch', 2), ('consumer_create', 'wake', 3), ('consumer_create', 'notes', 4)) AS t(action, consumer_name, consumer_id)")
def lake_audit_events(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_audit_events(lake.name).select("action", "consumer_name", "consumer_id")


@query(f"WITH {NATIONS_SQL} SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey, 5 AS score FROM n WHERE n_regionkey <> 3 UNION ALL SELECT 100, 'NEWLAND', 0, 9")
def lake_read_head(spark, sf_dir):
    return demo(spark, sf_dir)[1].read("nations").drop(ROWID, BEGIN, END)


@query("SELECT * FROM (VALUES (1, 'added', 1, NULL, 'n_nationkey', 'int'), (1, 'added', 2, NULL, 'n_name', 'string'), (1, 'added', 3, NULL, 'n_regionkey', 'int'), (8, 'added', 4, NULL, 'score', 'int')) AS t(snapshot_id, change_kind, column_id, old_name, new_name, new_type)")
def lake_schema_diff(spark, sf_dir):
    cdc, lake = demo(spark, sf_dir)
    return cdc.cdc_schema_diff(lake.name, "nations", 0, 11).select("snapshot_id", "change_kind", "column_id", "old_name", "new_name", "new_type")


@query()
def lake_lifecycle(spark, sf_dir):
    """Lease, commit, release and reset of a consumer of its own (state changes: no SQL for it)."""
    cdc, lake = demo(spark, sf_dir)
    name = f"tour_{uuid.uuid4().hex[:8]}"
    cdc.cdc_dml_consumer_create(lake.name, name, start_at="beginning", table_name="nations")
    w = cdc.cdc_window(lake.name, name, 3).first()
    rows = cdc.cdc_dml_changes_read(lake.name, name, max_snapshots=3).count()
    cdc.cdc_commit(lake.name, name, w.end_snapshot)
    cdc.cdc_consumer_heartbeat(lake.name, name)
    moved = cdc.cdc_consumer_reset(lake.name, name).first()
    cdc.cdc_window(lake.name, name)
    cdc.cdc_consumer_release(lake.name, name)
    cdc.cdc_consumer_drop(lake.name, name)
    return spark.createDataFrame([(w.start_snapshot, w.end_snapshot, rows, moved.previous_snapshot, moved.new_snapshot)], "start_snapshot long, end_snapshot long, n_rows long, reset_from long, reset_to long")
