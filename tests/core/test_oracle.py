"""Each registered query of the event study against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import events, operations, queries

QUERIES, ORACLE_SQL = queries.QUERIES | operations.QUERIES | events.QUERIES, queries.ORACLE_SQL | operations.ORACLE_SQL | events.ORACLE_SQL

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(x)[:-8]} AS SELECT * FROM read_parquet('{x}')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    text = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") and "00:00:00" in str(v) else f"{float(v):.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
    assert len(ours) or name in ("feature_violations",)
