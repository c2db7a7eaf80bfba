"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from staylens.operators import catalog
from staylens.plans import registry

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool, str)) or "bool" in type(v).__name__:
        return str(v)
    v = float(v)
    return str(int(v)) if v.is_integer() and abs(v) < 2**53 else f"{v:.6g}"


def _rows(df):
    return sorted([tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_catalogue_contract(spark):
    entry = catalog.CATALOG["preflight_rejections"]
    catalog.CATALOG["preflight_rejections"] = catalog.Entry(entry.fn, entry.scope, ("n_rejections",))
    try:
        with pytest.raises(catalog.ContractError):
            registry.QUERIES["preflight_rejections"](spark, SF)
    finally:
        catalog.CATALOG["preflight_rejections"] = entry


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
