"""Every registered query of the core library against its SQL twin on DuckDB."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from quillspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return v if v is None else bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 4) + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(name, spark, sf, duck):
    got = catalogue.queries()[name](spark, sf)
    want = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=key)
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only_queries_run(name, spark, sf):
    assert catalogue.queries()[name](spark, sf).count() > 0
