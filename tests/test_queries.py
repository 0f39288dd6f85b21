"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire import plans
from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, np.ndarray | list):
        return [plain(y) for y in x]
    if pd.isna(x):
        return None
    return float(x) if isinstance(x, bool | int | float | np.number | np.bool_) else str(x)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([plain(v) for v in row]) for row in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    assert rows_of(plans.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(plans.ORACLE[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
