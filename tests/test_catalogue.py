import math
from pathlib import Path

import duckdb
import pytest

from tablewright import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, found.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
