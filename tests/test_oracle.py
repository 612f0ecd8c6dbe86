"""Every query with SQL gives the rows that DuckDB gives. The queries run side by side, as most of their time is planning."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from sylvan.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in found), key=repr)


def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.fixture(scope="module")
def found(spark, request):
    """The rows of the selected queries, as they come."""

    def run(name):
        df = QUERIES[name](spark, SF)
        return rows(df.columns, [tuple(r) for r in df.collect()])

    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_oracle"]
    with ThreadPoolExecutor(6) as pool:
        futures = {n: pool.submit(run, n) for n in names}
        yield futures
        for f in futures.values():
            f.cancel()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(found, con, name):
    got = found[name].result()
    cur = con.execute(ORACLE_SQL[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
    assert got[1]
