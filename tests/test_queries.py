"""Each registered query that has SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__
from ebbtide.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def text(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = con.sql(queries.ORACLE[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted([text(x[c]) for c in cols] for x in df.collect()) == sorted([text(x[i]) for i in at] for x in r.fetchall())


def test_entry_and_rows_only_queries(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    assert queries.QUERIES["lake_lifecycle"](spark, sf_dir).first().n_rows == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
