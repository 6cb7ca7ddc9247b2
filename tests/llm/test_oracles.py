from pathlib import Path

import duckdb
import pytest

from tablewright.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(repr, r)) for r in found.fetchall())
    assert sorted(tuple(map(repr, r)) for r in df.select(*names).collect()) == want


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
