"""Every registered query runs, and gives what its SQL gives, on the smallest tables."""

import glob
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, (float, Decimal)):
        return str(round(float(v), 6))
    return str(v.item() if hasattr(v, "item") else v)


def rows(pdf):
    return sorted(tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


NAMES = sorted(n for n in entry.queries() if not n.startswith(("p1_", "p3_", "p5_", "p6_", "p7_", "p8_")))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        assert rows(got) == rows(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "acronym", "first_pos", "mentions", "nth"]
