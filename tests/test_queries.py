"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from locusframe.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(f"{float(v):.10g}")
    return v


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        made.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    out = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(out)
        return
    want = con.sql(sql).df()
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(out) == rows(want)


def test_interval_lookup_is_whole(spark, con):
    """The lookup before f17's filter covers every contig: none of the significant rows is missing."""
    want = con.sql(registry.PRELUDE + " select count(*) as n from variants where pvalue < 1e-6").df().n[0]
    assert registry.queries()["f17_where_after_interval"](spark, SF).count() == want
    assert want == len(con.sql(registry.oracle_sql()["f17_where_after_interval"]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
