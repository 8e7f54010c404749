"""Every registered query against its oracle in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from weft.plans.catalog import ORACLES, QUERIES


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "~" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    ours, theirs = table(QUERIES[name](spark, sf_dir).toPandas()), table(duck.sql(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(5).count() > 0
