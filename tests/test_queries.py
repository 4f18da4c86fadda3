"""Every query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest

from talus.plans import registry
from talus.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame):
    cols = sorted(frame.columns)
    one = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return cols, sorted((tuple(map(one, r)) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
