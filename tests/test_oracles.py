"""Every route query that has SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from ridgeline.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert ours
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        theirs = [d[0] for d in result.description]
        assert sorted(theirs) == columns
        at = [theirs.index(c) for c in columns]
        assert ours == sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
