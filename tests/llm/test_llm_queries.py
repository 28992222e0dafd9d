"""The subpackage's queries run on the smallest tables, and give what their SQL gives."""

import os

import pytest

from proseframe.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    assert got
    if name in Q.ORACLE:
        import duckdb

        c = duckdb.connect()
        for t in ("paragraphs", "context_cache", "size_limits", "mix_targets", "documents"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.execute(Q.ORACLE[name]).fetchdf()
        assert got == sorted(map(tuple, want[sorted(want.columns)].itertuples(index=False)), key=str)
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
