"""Differential tests: every query with an oracle matches DuckDB on sf0.001
(order-insensitive, columns matched by name) — the driver's gate, small."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from check_oracle import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from check_oracle import digest
    df = E.queries()[name](spark, SF)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    assert len(srows) == len(drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["scan_id", "file", "score", "unsupported", "partial", "total", "rank"]
    assert len(rows) > 0


def test_every_query_builds(spark):
    """Queries without an oracle at least analyse and run on sf0.001."""
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    for name in sorted(set(qs) - set(oracle)):
        qs[name](spark, SF).collect()
