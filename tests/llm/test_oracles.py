"""Queries with SQL against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest
from lodestrata.llm.queries import ORACLES, QUERIES

from ..test_oracles import TABLES, plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(cols)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*cols).collect()) == want
