"""Every registered query against DuckDB running its SQL, as the driver compares them."""

import glob
import math
import os

import duckdb
import pytest

from folioframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    if isinstance(x, list):
        return [plain(y) for y in x]
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    result = catalogue.queries()[name](spark, SF)
    names = sorted(result.columns)
    rows = sorted((str([plain(r[c]) for c in names]) for r in result.collect()))
    assert rows
    if name in catalogue.oracle_sql():
        other = duck.sql(catalogue.oracle_sql()[name])
        at = {c: i for i, c in enumerate(other.columns)}
        assert sorted(at) == names
        want = sorted(str([plain(r[at[c]]) for c in names]) for r in other.fetchall())
        assert len(rows) == len(want)
        assert rows == want
