"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr([plain(v) for v in r]) for r in df.select(*cols).collect()))
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr([plain(v) for v in r]) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got == want
