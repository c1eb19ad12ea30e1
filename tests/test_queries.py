"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioscope.plans import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), list(frame.columns)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(engine.queries()[name](spark, SF).toPandas()) == rows(duck.execute(engine.oracle_sql()[name]).df())



def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
