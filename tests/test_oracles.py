"""Every query with an SQL statement gives the same rows as DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem embeddings documents pages labels".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["county", "year", "r_mental1", "r_mental3", "r_mentaln"]
    assert df.count() > 0


def test_inventory_is_covered():
    have = {n.split("_")[0] for n in entry.queries()}
    want = (
        {f"io{i}" for i in range(1, 10)} | {f"pr{i}" for i in range(1, 26)} | {f"fl{i}" for i in range(1, 7)}
        | {f"jn{i}" for i in range(1, 9)} | {f"ag{i}" for i in range(1, 10)} | {f"wn{i}" for i in range(1, 8)}
        | {"or1", "st1"} | {f"rs{i}" for i in range(1, 6)} | {f"rt{i}" for i in range(1, 14)}
        | {f"cv{i}" for i in range(1, 10)} | {f"sp{i}" for i in range(1, 13)} | {f"pn{i}" for i in range(1, 7)}
        | {f"md{i}" for i in range(1, 8)} | {f"ps{i}" for i in range(1, 13)} | {f"dg{i}" for i in range(1, 10)}
    )
    assert want <= have, sorted(want - have)
