"""Every registered query with an oracle matches DuckDB (row count, columns, values) at sf0.001."""

import pytest

import __spark_entry__ as E
from pneuma.oracle import compare, duckdb_conn
from pneuma.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load_all()
KEYS = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    spdf = sdf.toPandas()
    dpdf = con.execute(E.oracle_sql()[key]).df()
    r = compare(spdf, dpdf)
    assert r["ok"], r
    duck_types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {E.oracle_sql()[key]}").fetchall()}
    diffs = [(c, t, duck_types.get(c)) for c, t in sdf.dtypes if SPARK_TO_DUCK.get(t, t) != duck_types.get(c)]
    assert not diffs, diffs


def test_every_key_has_builder():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
