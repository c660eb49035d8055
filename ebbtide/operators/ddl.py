"""Schema-change events, their ticks, and per-table schema diffs, from metadata frames with set-based joins.

Change maps are exploded once; each kind of entry is resolved by a join on the snapshot at which names or ids
held. Metadata is small beside data: the id and name joins below are equi-joins with an interval condition, so Spark can
broadcast a small side and hash a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.tokens import DDL_TOKENS, exploded, strict_id
from ebbtide.meta import Catalog, alive_at, split_name

EVENT_COLUMNS = ["snapshot_id", "snapshot_time", "event_kind", "object_kind", "schema_id", "schema_name", "object_id", "object_name", "details"]
#: Order of the groups of an altered table's details (fixed values).
DIFF_KINDS = ("added", "dropped", "renamed", "type_changed", "default_changed", "nullable_changed")
#: Nesting deeper than this is not followed.
MAX_DEPTH = 64


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _with_parent(parent: Column, *fields: Column) -> Column:
    """The object, with parent_column_id only where there is one."""
    return F.when(parent.isNull(), _json(*fields)).otherwise(_json(*fields, parent.alias("parent_column_id")))


def _entries(catalog: Catalog, lo: int, hi: int) -> DataFrame:
    e = exploded(catalog.changes.filter(F.col("snapshot_id").between(lo, hi)), DDL_TOKENS)
    dot = F.instr("value", ".")
    return (
        e.withColumn("by_id", strict_id(F.col("value")))
        .withColumn("in_schema", F.when(dot > 0, F.substring("value", F.lit(1), dot - 1)))
        .withColumn("by_name", F.when(dot > 0, F.substring("value", dot + 1, F.length("value"))))
        .withColumn("event_kind", F.when(F.col("key").endswith("created"), "created").when(F.col("key").endswith("altered"), "altered").otherwise("dropped"))
        .withColumn("object_kind", F.when(F.col("key").startswith("schemas"), "schema").when(F.col("key").startswith("views"), "view").otherwise("table"))
        .withColumn("as_of", F.col("snapshot_id") - (F.col("event_kind") == "dropped").cast("long"))
    )


def _objects(catalog: Catalog) -> DataFrame:
    """Tables and views with their schema's name while both hold."""
    t = catalog.tables.select(F.lit("table").alias("kind"), F.col("table_id").alias("object_id"), F.col("table_name").alias("object_name"), "schema_id", "begin_snapshot", "end_snapshot")
    v = catalog.views.select(F.lit("view").alias("kind"), F.col("view_id").alias("object_id"), F.col("view_name").alias("object_name"), "schema_id", "begin_snapshot", "end_snapshot")
    s = catalog.schemas.select(F.col("schema_id").alias("sid"), "schema_name", F.col("begin_snapshot").alias("s_begin_snapshot"), F.col("end_snapshot").alias("s_end_snapshot"))
    return t.unionByName(v).join(s, F.col("schema_id") == F.col("sid")).drop("sid")


def _columns_at(catalog: Catalog, wanted: DataFrame, shift: int) -> DataFrame:
    """snapshot_id, table_id and the columns that held at snapshot_id + shift, for the wanted (snapshot_id, table_id)."""
    c = catalog.columns.withColumnRenamed("table_id", "tid")
    return wanted.join(c, F.col("table_id") == F.col("tid")).filter(alive_at(F.col("snapshot_id") + F.lit(shift))).drop("tid", "begin_snapshot", "end_snapshot")


def _depths(catalog: Catalog) -> DataFrame:
    """dt, dc, depth: how deep each column is nested (a column's parent never changes); one small join for each level there is."""
    c = catalog.columns.select(F.col("table_id").alias("dt"), F.col("column_id").alias("dc"), "parent_column").distinct()
    out = level = c.filter("parent_column is null").select("dt", "dc", F.lit(0).alias("depth"))
    nested = c.filter("parent_column is not null")
    for _ in range(MAX_DEPTH if not nested.isEmpty() else 0):
        up = level.select(F.col("dt").alias("ut"), F.col("dc").alias("uc"), F.col("depth").alias("ud"))
        level = nested.join(up, (F.col("dt") == F.col("ut")) & (F.col("parent_column") == F.col("uc"))).select("dt", "dc", (F.col("ud") + 1).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _depth(columns: DataFrame, catalog: Catalog) -> DataFrame:
    """columns with their nesting depth."""
    out = columns.join(_depths(catalog), (F.col("table_id") == F.col("dt")) & (F.col("column_id") == F.col("dc")), "left")
    return out.drop("dt", "dc").withColumn("depth", F.coalesce("depth", F.lit(MAX_DEPTH)))


def _first_snapshots(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_id: where each table was created."""
    return catalog.tables.groupBy("table_id").agg(F.min("begin_snapshot").alias("snapshot_id"))


def column_diffs(catalog: Catalog, lo: int, hi: int) -> DataFrame:
    """One row for each way in which a column differs between snapshot_id - 1 and snapshot_id, for existing tables whose columns changed in the range.

    A column that changed in several ways gives several rows. Which tables changed is known from the schema versions alone, so the plan does
    not repeat that of the events."""
    wanted = catalog.schema_versions.select(F.col("begin_snapshot").alias("snapshot_id"), "table_id").filter(F.col("snapshot_id").between(lo, hi)).distinct()
    wanted = wanted.join(_first_snapshots(catalog), ["snapshot_id", "table_id"], "left_anti")
    names = {"column_name": "name", "column_type": "type", "default_value": "default", "nulls_allowed": "nullable", "parent_column": "parent", "column_order": "order", "depth": "depth"}

    def side(shift: int, tag: str) -> DataFrame:
        c = _depth(_columns_at(catalog, wanted, shift), catalog)
        return c.select(F.col("snapshot_id").alias(f"{tag}_s"), F.col("table_id").alias(f"{tag}_t"), F.col("column_id").alias(f"{tag}_c"), *[F.col(k).alias(f"{tag}_{n}") for k, n in names.items()])

    old, new = side(-1, "old"), side(0, "new")
    both = old.join(new, (F.col("old_s") == F.col("new_s")) & (F.col("old_t") == F.col("new_t")) & (F.col("old_c") == F.col("new_c")), "full_outer")
    kept = F.col("old_c").isNotNull() & F.col("new_c").isNotNull()
    differs = lambda a: ~F.col(f"old_{a}").eqNullSafe(F.col(f"new_{a}"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("old_c").isNull(), "added"), F.when(F.col("new_c").isNull(), "dropped"), F.when(kept & differs("name"), "renamed"),
            F.when(kept & differs("type"), "type_changed"), F.when(kept & differs("default"), "default_changed"), F.when(kept & differs("nullable"), "nullable_changed"),
        )
    )
    out = both.withColumn("snapshot_id", F.coalesce("new_s", "old_s")).withColumn("table_id", F.coalesce("new_t", "old_t")).withColumn("column_id", F.coalesce("new_c", "old_c"))
    out = out.withColumn("change_kind", F.explode(kinds))
    rank = sum((F.when(F.col("change_kind") == k, i).otherwise(0) for i, k in enumerate(DIFF_KINDS)), F.lit(0))
    # parents come before their children when added, and after them when dropped
    within = F.when(F.col("change_kind") == "dropped", -F.col("old_depth")).when(F.col("change_kind") == "added", F.col("new_depth")).otherwise(0)
    return out.withColumn("kind_rank", rank).withColumn("within", within)


def _created_details(catalog: Catalog, lo: int, hi: int) -> DataFrame:
    c = _columns_at(catalog, _first_snapshots(catalog).filter(F.col("snapshot_id").between(lo, hi)), 0)
    item = _with_parent(F.col("parent_column"), F.col("column_id").alias("id"), F.col("column_order").alias("order"), F.col("column_name").alias("name"), F.col("column_type").alias("type"), F.col("nulls_allowed").alias("nullable"), F.col("default_value").alias("default"))
    rows = c.groupBy("snapshot_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_order", "column_id", item.alias("j")))), lambda x: x["j"]), ",").alias("items"))
    return rows.select(F.col("snapshot_id").alias("ds"), F.col("table_id").alias("dt"), F.concat(F.lit('{"columns":['), "items", F.lit("]}")).alias("created_details"))


def _diff_item() -> Column:
    c = F.col
    whole = {t: _with_parent(c(f"{t}_parent"), c("column_id").alias("id"), c(f"{t}_name").alias("name"), c(f"{t}_type").alias("type"), c(f"{t}_nullable").alias("nullable"), c(f"{t}_default").alias("default")) for t in ("new", "old")}
    pair = lambda a: _json(c("column_id").alias("id"), c("new_name").alias("name"), c(f"old_{a}"), c(f"new_{a}"))
    k = c("change_kind")
    return (
        F.when(k == "added", whole["new"]).when(k == "dropped", whole["old"]).when(k == "renamed", _json(c("column_id").alias("id"), c("old_name"), c("new_name")))
        .when(k == "type_changed", pair("type")).when(k == "default_changed", pair("default")).otherwise(pair("nullable"))
    )


def _altered_details(catalog: Catalog, lo: int, hi: int) -> DataFrame:
    d = column_diffs(catalog, lo, hi).withColumn("item", _diff_item())
    groups = d.groupBy("snapshot_id", "table_id", "kind_rank", "change_kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("within", "column_id", "item"))), lambda x: x["item"]), ",").alias("items"))
    groups = groups.withColumn("text", F.concat(F.lit('"'), "change_kind", F.lit('":['), "items", F.lit("]")))
    rows = groups.groupBy("snapshot_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_rank", "text"))), lambda x: x["text"]), ",").alias("diff_details"))
    return rows.select(F.col("snapshot_id").alias("fs"), F.col("table_id").alias("ft"), "diff_details")


def ddl_events(catalog: Catalog, lo: int, hi: int) -> DataFrame:
    """The nine event columns and `place` (order within a snapshot) for snapshots lo to hi, both included."""
    e = _entries(catalog, lo, hi)
    s = catalog.schemas.select(F.col("schema_id").alias("oid"), F.col("schema_name").alias("oname"), "begin_snapshot", "end_snapshot")
    of_schema = e.filter("object_kind = 'schema'")
    held = F.when(F.col("event_kind") == "created", (F.col("oname") == F.col("value")) & (F.col("begin_snapshot") == F.col("snapshot_id"))).otherwise((F.col("oid") == F.col("by_id")) & alive_at(F.col("as_of")))
    created, dropped = of_schema.filter("event_kind = 'created'"), of_schema.filter("event_kind = 'dropped'")
    schemas = created.join(s, (F.col("value") == F.col("oname")) & held, "left").unionByName(dropped.join(s, (F.col("by_id") == F.col("oid")) & held, "left"))
    schemas = schemas.select("snapshot_id", "place", "event_kind", "object_kind", F.coalesce("oid", "by_id").alias("schema_id"), F.coalesce("oname", F.when(F.col("event_kind") == "created", F.col("value"))).alias("schema_name"), F.coalesce("oid", "by_id").alias("object_id"), F.coalesce("oname", F.when(F.col("event_kind") == "created", F.col("value"))).alias("object_name"))
    o = _objects(catalog)
    rest = e.filter("object_kind <> 'schema'")
    named = rest.filter("event_kind = 'created'").join(
        o, (F.col("object_kind") == F.col("kind")) & (F.col("snapshot_id") == F.col("begin_snapshot")) & (F.col("in_schema") == F.col("schema_name")) & (F.col("by_name") == F.col("object_name")) & alive_at(F.col("snapshot_id"), "s_"), "left"
    )
    named = named.select("snapshot_id", "place", "event_kind", "object_kind", "schema_id", F.col("in_schema").alias("schema_name"), "object_id", F.col("by_name").alias("object_name"))
    by_id = rest.filter("event_kind <> 'created'").join(o, (F.col("object_kind") == F.col("kind")) & (F.col("by_id") == F.col("object_id")) & alive_at(F.col("as_of")) & alive_at(F.col("as_of"), "s_"), "left")
    by_id = by_id.select("snapshot_id", "place", "event_kind", "object_kind", "schema_id", "schema_name", F.coalesce("object_id", "by_id").alias("object_id"), "object_name")
    # a table that is created under a name while it had another one before was renamed
    before = catalog.tables.select(F.col("table_id").alias("pt"), F.col("table_name").alias("old_name"), F.col("begin_snapshot").alias("pb"))
    tables = named.filter("object_kind = 'table'").join(before, (F.col("object_id") == F.col("pt")) & (F.col("pb") < F.col("snapshot_id")), "left")
    tables = tables.groupBy("snapshot_id", "place", "event_kind", "object_kind", "schema_id", "schema_name", "object_id", "object_name").agg(F.max_by("old_name", "pb").alias("old_name"))
    tables = tables.withColumn("renamed", F.col("old_name").isNotNull() & (F.col("old_name") != F.col("object_name")))
    tables = tables.withColumn("event_kind", F.when(F.col("renamed"), "altered").otherwise(F.col("event_kind")))
    rows = schemas.unionByName(named.filter("object_kind = 'view'")).unionByName(by_id).unionByName(tables, allowMissingColumns=True)
    # of a renamed table's alteration in the same snapshot only the rename stays, which has the column changes too
    same = Window.partitionBy("snapshot_id", "object_kind", "event_kind", "object_id")
    moved = F.coalesce(F.max("renamed").over(same), F.lit(False))
    rows = rows.withColumn("moved", moved).filter(~((F.col("object_kind") == "table") & (F.col("event_kind") == "altered") & F.col("moved")) | F.coalesce("renamed", F.lit(False)))
    rows = rows.join(_created_details(catalog, lo, hi), (F.col("snapshot_id") == F.col("ds")) & (F.col("object_id") == F.col("dt")), "left")
    rows = rows.join(_altered_details(catalog, lo, hi), (F.col("snapshot_id") == F.col("fs")) & (F.col("object_id") == F.col("ft")), "left")
    views = catalog.views.select(F.col("view_id").alias("vid"), F.col("begin_snapshot").alias("vb"), _json(F.col("sql").alias("definition"), F.col("dialect"), F.col("column_aliases")).alias("view_details"))
    rows = rows.join(views, (F.col("object_kind") == "view") & (F.col("event_kind") == "created") & (F.col("object_id") == F.col("vid")) & (F.col("snapshot_id") == F.col("vb")), "left")
    name = lambda c: F.substring_index(F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1_000_000), "}", 1)
    rename = F.when(F.col("renamed"), F.concat(F.lit('"old_table_name":'), name("old_name"), F.lit(',"new_table_name":'), name("object_name")))
    altered_text = F.concat(F.lit("{"), F.concat_ws(",", rename, F.col("diff_details")), F.lit("}"))
    kind, event = F.col("object_kind"), F.col("event_kind")
    details = F.when((kind == "table") & (event == "created"), F.coalesce("created_details", F.when(F.col("schema_id").isNotNull(), '{"columns":[]}'), F.lit("{}"))).when((kind == "table") & (event == "altered"), altered_text)
    details = F.coalesce(details, F.when((kind == "view") & (event == "created"), F.col("view_details")), F.lit("{}"))
    drop = event == "dropped"
    rank = F.when(kind == "schema", F.when(drop, 2).otherwise(0)).when(kind == "view", 1).otherwise(F.when(drop, 0).otherwise(2))
    times = catalog.snapshot.select(F.col("snapshot_id").alias("ts"), "snapshot_time")
    rows = rows.join(times, F.col("snapshot_id") == F.col("ts"))
    in_snapshot = Window.partitionBy("snapshot_id").orderBy(rank, F.col("object_id").asc_nulls_last(), "place")
    return rows.withColumn("details", details).withColumn("place", F.row_number().over(in_snapshot)).select(*EVENT_COLUMNS, "place")


def filter_events(events: DataFrame, schema_ids: list[int] | None, table_ids: list[int] | None) -> DataFrame:
    """Events of these schemas or of these tables; without either, all."""
    if schema_ids is None and table_ids is None:
        return events
    hit = F.lit(False)
    if schema_ids:
        hit = hit | F.coalesce(F.col("schema_id").isin(*schema_ids), F.lit(False))
    if table_ids:
        hit = hit | F.coalesce((F.col("object_kind") == "table") & F.col("object_id").isin(*table_ids), F.lit(False))
    return events.filter(hit)


def ddl_ticks(catalog: Catalog, events: DataFrame) -> DataFrame:
    """One row for each snapshot that has events."""
    t = events.groupBy("snapshot_id").agg(
        F.array_sort(F.collect_set("schema_id")).alias("schema_ids"),
        F.array_sort(F.collect_set(F.when(F.col("object_kind") == "table", F.col("object_id")))).alias("table_ids"),
        F.count("*").alias("change_count"),
    )
    made = catalog.changes.select("snapshot_id", "changes_made")
    return catalog.snapshot.join(made, "snapshot_id").join(t, "snapshot_id").select("snapshot_id", "snapshot_time", "schema_version", "changes_made", "schema_ids", "table_ids", "change_count").orderBy("snapshot_id")


def table_ids_named(catalog: Catalog, name: str, lo: int, hi: int) -> DataFrame:
    """Every table that bore the name at some snapshot of the range: table_id."""
    schema, table = split_name(name)
    return _objects(catalog).filter((F.col("kind") == "table") & (F.col("schema_name") == schema) & (F.col("object_name") == table) & (F.col("begin_snapshot") <= hi) & (F.col("end_snapshot").isNull() | (F.col("end_snapshot") > lo))).select(F.col("object_id").alias("table_id")).distinct()


def schema_diff(catalog: Catalog, name: str, lo: int, hi: int) -> DataFrame:
    """The 13 columns of a per-table diff: creation as added columns, renames of the table, and column changes."""
    ids = table_ids_named(catalog, name, lo, hi)
    events = ddl_events(catalog, lo, hi).filter("object_kind = 'table' and event_kind in ('created', 'altered')").join(ids.withColumnRenamed("table_id", "t"), F.col("object_id") == F.col("t"), "left_semi")
    null = lambda kind, alias: F.lit(None).cast(kind).alias(alias)
    mine = _first_snapshots(catalog).filter(F.col("snapshot_id").between(lo, hi)).join(ids, "table_id", "left_semi")
    created = _depth(_columns_at(catalog, mine, 0), catalog)
    created = created.select("snapshot_id", F.lit("added").alias("change_kind"), "column_id", null("string", "old_name"), F.col("column_name").alias("new_name"), null("string", "old_type"), F.col("column_type").alias("new_type"), null("string", "old_default"), F.col("default_value").alias("new_default"), null("boolean", "old_nullable"), F.col("nulls_allowed").alias("new_nullable"), F.col("parent_column").alias("parent_column_id"), F.lit(1).alias("kind_rank"), F.col("depth").alias("within"), F.col("column_order").alias("nth"))
    altered = events.filter("event_kind = 'altered'")
    old = F.get_json_object("details", "$.old_table_name")
    renames = altered.filter(old.isNotNull()).select("snapshot_id", F.lit("table_rename").alias("change_kind"), null("long", "column_id"), old.alias("old_name"), F.col("object_name").alias("new_name"), *[null("string", c) for c in ("old_type", "new_type", "old_default", "new_default")], *[null("boolean", c) for c in ("old_nullable", "new_nullable")], null("long", "parent_column_id"), F.lit(0).alias("kind_rank"), F.lit(0).alias("within"), F.lit(0).cast("long").alias("nth"))
    d = column_diffs(catalog, lo, hi).join(ids, "table_id", "left_semi")
    k = F.col("change_kind")
    add, gone = k == "added", k == "dropped"
    of = lambda yes, c: F.when(yes, F.col(c)).alias(c)
    diffs = d.select(
        "snapshot_id", "change_kind", "column_id", of(~add, "old_name"), of(~gone, "new_name"), of(gone | (k == "type_changed"), "old_type"), of(add | (k == "type_changed"), "new_type"),
        of(gone | (k == "default_changed"), "old_default"), of(add | (k == "default_changed"), "new_default"), of(gone | (k == "nullable_changed"), "old_nullable"), of(add | (k == "nullable_changed"), "new_nullable"),
        F.when(add, F.col("new_parent")).when(gone, F.col("old_parent")).alias("parent_column_id"), (F.col("kind_rank") + 1).alias("kind_rank"), "within", F.col("column_id").alias("nth"),
    )
    rows = created.unionByName(renames).unionByName(diffs)
    rows = rows.join(catalog.snapshot.select("snapshot_id", "snapshot_time"), "snapshot_id")
    columns = ["snapshot_id", "snapshot_time", "change_kind", "column_id", "old_name", "new_name", "old_type", "new_type", "old_default", "new_default", "old_nullable", "new_nullable", "parent_column_id"]
    return rows.orderBy("snapshot_id", "kind_rank", "within", "nth").select(*columns)
