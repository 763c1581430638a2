"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        d.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return d


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, int | str | bool) else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        cols = [c[0] for c in want.description]
        assert _rows(got.columns, rows) == _rows(cols, want.fetchall())
    else:
        assert rows
