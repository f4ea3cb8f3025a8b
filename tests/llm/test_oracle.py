import duckdb
import pytest

from vqaframe.llm.oracle import SQL
from vqaframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(d[0] for d in want.description)
    order = [d[0] for d in want.description]
    a = sorted(str([r[c] for c in cols]) for r in got.collect())
    b = sorted(str([dict(zip(order, r))[c] for c in cols]) for r in want.fetchall())
    assert a == b
