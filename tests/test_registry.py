"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from marginalia.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    cells = (tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)
    return sorted(cells, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(map(tuple, df.select(*cols).collect()))
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert got == plain(want)


def test_map_rows(spark):
    rows = QUERIES["map_rows"](spark, SF).collect()
    assert rows and all(len(r["row"]) == 1 for r in rows)
