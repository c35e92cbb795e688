"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from dialoom import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in "documents conversations pages labels benchmark events".split():
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = db.execute(catalogue.SQL[name])
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in rows) == sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in got.fetchall())
