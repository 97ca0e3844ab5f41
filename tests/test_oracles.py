"""Every query with SQL gives the rows that DuckDB gives for that SQL on the same tables."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest
from lodestrata.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(spark, name, d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = registry.QUERIES[name](spark, d)
    cur = con.execute(registry.ORACLES[name])
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(want_cols)
    order = [want_cols.index(c) for c in got.columns]
    a = Counter(tuple(map(plain, r)) for r in got.collect())
    b = Counter(tuple(plain(r[i]) for i in order) for r in want)
    assert a == b, (len(list(a.elements())), len(want), list((a - b).items())[:3], list((b - a).items())[:3])
    return sum(a.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001") >= 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns
    got.collect()
