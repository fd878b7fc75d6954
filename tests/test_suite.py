"""Some of the registered queries against their SQL, at the smallest scale."""

import duckdb
import pytest

from spanlake.plans import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = suite.QUERIES[name](spark, SF)
    want = db.sql(suite.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))
