"""Queries against their DuckDB text."""

import duckdb
import pytest

from corpusloom.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v if isinstance(v, (str, bool, type(None))) else int(v)


def both(spark, name, sf):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr), sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    got, expected = both(spark, name, SF)
    assert got == expected and got


def test_licences_on_more_rows(spark):
    got, expected = both(spark, "op9_license_set_join", "/root/testdata/sf0.01")
    assert got == expected and sum(bool(r[3]) for r in got) > 10
