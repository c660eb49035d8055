import duckdb
import pytest

from ebbtide.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, r = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted([str(x[c]) for c in cols] for x in df.collect()) == sorted([str(x[i]) for i in at] for x in r.fetchall())
