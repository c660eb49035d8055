"""The metadata of a lake as DataFrames, and the predicates that everything else shares.

Metadata rows are bi-temporal: a row holds from begin_snapshot until before end_snapshot (null: still).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "snapshot": "snapshot_id long, snapshot_time timestamp, schema_version long",
    "changes": "snapshot_id long, changes map<string,array<string>>, changes_made string, author string, commit_message string, commit_extra_info string",
    "schemas": "schema_id long, schema_name string, begin_snapshot long, end_snapshot long",
    "tables": "table_id long, table_name string, schema_id long, begin_snapshot long, end_snapshot long",
    "views": "view_id long, view_name string, schema_id long, sql string, dialect string, column_aliases string, begin_snapshot long, end_snapshot long",
    "columns": "table_id long, column_id long, column_order long, column_name string, column_type string, nulls_allowed boolean, default_value string, parent_column long, begin_snapshot long, end_snapshot long",
    "schema_versions": "table_id long, begin_snapshot long",
}
SUPPORTED_VERSIONS = ("0.4", "1.0")
MAIN = "main"


@dataclass
class Catalog:
    """One DataFrame for each metadata table, with the columns of SCHEMAS."""

    snapshot: DataFrame
    changes: DataFrame
    schemas: DataFrame
    tables: DataFrame
    views: DataFrame
    columns: DataFrame
    schema_versions: DataFrame


def alive_at(snapshot: Column | int, prefix: str = "") -> Column:
    """Rows that hold at a snapshot; the end is exclusive."""
    s = F.lit(snapshot) if isinstance(snapshot, int) else snapshot
    begin, end = F.col(f"{prefix}begin_snapshot"), F.col(f"{prefix}end_snapshot")
    return (begin <= s) & (end.isNull() | (end > s))


def qualified(name: str) -> str:
    """A name without schema is in main."""
    return name if "." in name else f"{MAIN}.{name}"


def split_name(name: str) -> tuple[str, str]:
    schema, _, table = qualified(name).partition(".")
    return schema, table


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a local relation, whose size the optimizer knows: joins with small ones are broadcast."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], kind)
    fields = to_arrow_schema(kind)
    columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)
