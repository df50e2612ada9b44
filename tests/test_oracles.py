"""Every registered query with SQL, against DuckDB on the same tables: names, types and values."""

import os

import duckdb
import pandas as pd
import pytest

from gridfare.plans import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and pd.isna(value)):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def _rows(frame, names):
    return sorted(tuple(_cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    relation = duck.sql(catalog.ORACLES[name])
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    assert ours == theirs
    names = sorted(ours)
    assert _rows(df.toPandas(), names) == _rows(relation.df(), names)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
