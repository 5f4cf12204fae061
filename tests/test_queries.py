"""Every registered query of the engine proper against its SQL, on the smallest fixture."""

import os

import duckdb
import pytest

from corvane.plans import registry
from corvane.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables are not here")


def plain(value):
    if value is None or value != value:
        return None
    return float(f"{value:.8g}") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    key = lambda row: [str(x) for x in row]
    want = sorted(([plain(r[i]) for i in place] for r in result.fetchall()), key=key)
    assert sorted(([plain(v) for v in r] for r in got), key=key) == want
