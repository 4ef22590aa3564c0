import duckdb
import pytest

import __spark_entry__ as entry
from docloom import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(round(float(v), 6)) if hasattr(v, "real") and not isinstance(v, bool) else repr(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "c_custkey"
    assert set(entry.oracle_sql()) <= set(entry.queries())
