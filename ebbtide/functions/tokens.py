"""The vocabulary of change sets: map keys, and the text form with one token for each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the change map that stand for schema changes, and the token each has in text.
DDL_TOKENS = {
    "schemas_created": "created_schema",
    "schemas_dropped": "dropped_schema",
    "tables_created": "created_table",
    "tables_altered": "altered_table",
    "tables_dropped": "dropped_table",
    "views_created": "created_view",
    "views_dropped": "dropped_view",
}
#: Keys that stand for row changes.
DML_TOKENS = {
    "tables_inserted_into": "inserted_into_table",
    "tables_deleted_from": "deleted_from_table",
    "inlined_insert": "inlined_insert",
    "inlined_delete": "inlined_delete",
}
#: Fixed value: maintenance, neither a schema nor a row change.
OTHER_TOKENS = {"merge_adjacent": "merge_adjacent"}
TOKENS = DDL_TOKENS | DML_TOKENS | OTHER_TOKENS
BY_NAME = ("schemas_created", "tables_created", "views_created")


def token_text(changes: dict[str, list[str]]) -> str:
    """changes_made of a change map: names are quoted part by part, ids are not."""

    def one(key: str, value: str) -> str:
        quoted = ".".join(f'"{p}"' for p in value.split(".", 1)) if key in BY_NAME else value
        return f"{TOKENS[key]}:{quoted}"

    # drops before creates, so that a replaced view reads in the order it happened
    keys = sorted(changes, key=lambda k: (not k.endswith("dropped"), list(TOKENS).index(k)))
    return ",".join(one(k, v) for k in keys for v in changes[k])


def exploded(changes: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """snapshot_id, key, value, place: one row for each value of the change maps, in map order."""
    entries = changes.select("snapshot_id", F.posexplode(F.map_entries("changes")).alias("k", "entry"))
    if keys is not None:
        entries = entries.filter(F.col("entry.key").isin(*keys))
    return entries.select("snapshot_id", F.col("entry.key").alias("key"), "k", F.posexplode("entry.value").alias("v", "value")).select("snapshot_id", "key", "value", (F.col("k") * 100_000 + F.col("v")).alias("place"))


def strict_id(value: Column) -> Column:
    """The whole text as a 64-bit integer, else null."""
    return F.when(value.rlike(r"^-?[0-9]{1,19}$"), F.expr("try_cast(value as bigint)"))
