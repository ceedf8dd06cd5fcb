"""A session for all tests, and a comparison of a query with its oracle."""

from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    s = session("tests", cpus=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Asserts that a query and its oracle give the same columns and rows, and returns the count."""

    def check(build, sql):
        df = build(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
        ran = duck.execute(sql)
        columns = [d[0] for d in ran.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        want = sorted(tuple(shown(r[i]) for i in at) for r in ran.fetchall())
        assert got == want
        return len(got)

    return check
