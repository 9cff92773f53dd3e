import duckdb
import pytest

import __spark_entry__ as entry
from loomspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    out = []
    for row in rows:
        out.append(tuple(float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
