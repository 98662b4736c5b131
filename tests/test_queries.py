"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert plain(got) == plain(duck.execute(sql).fetchdf())
    assert len(got) > 0


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
