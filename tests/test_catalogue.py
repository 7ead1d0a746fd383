"""Every registered query of the comparison engine against its SQL, on small tables in the schema of the test data."""

from pathlib import Path

import duckdb
import pytest

from foliodiff.plans import catalogue

SMALL = Path("/root/testdata/sf0.001")
TABLES = ("documents", "customer", "nation", "orders", "events", "pages")


@pytest.mark.skipif(not SMALL.is_dir(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(columns).collect())))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert got == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
