"""Every SQL-expressible query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import _rows
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    # column types agree with the oracle's
    st = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in df.schema.fields}
    dt = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert st == dt
    sdf = df.toPandas()
    odf = duck.execute(ORACLE[name]).df()
    sc, sr = _rows(sdf)
    oc, orr = _rows(odf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "h3_price_percentile" in df.columns


def test_every_query_has_unique_name():
    q = E.queries()
    assert len(q) >= 120
    assert set(ORACLE) <= set(q)


def test_package_zip_for_workers():
    import zipfile
    path = E._package_zip()
    names = zipfile.ZipFile(path).namelist()
    assert "valora/__init__.py" in names and "valora/operators/treeshap.py" in names
    assert E._package_zip() == path  # content-hashed: stable while the code is unchanged
