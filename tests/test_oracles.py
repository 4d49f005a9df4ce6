"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from pagewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{value:.5g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    want = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows and rows
