"""Every registered query with SQL gives what DuckDB gives, at the smallest size."""

import glob
import hashlib
import math
import os

import duckdb
import pytest

from paramscan.queries import QUERIES, SQL

DATA = os.environ.get("PARAMSCAN_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_sha512(spark, db):
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r.sha512 for r in QUERIES["digest_sha512"](spark, DATA).collect()}
    assert got == {k: t if t is None else hashlib.sha512(t.encode()).hexdigest() for k, t in texts.items()}


def test_no_oracle_is_empty(db):
    empty = [name for name, sql in SQL.items() if not db.execute(sql).fetchall()]
    assert set(empty) <= {"except_all", "join_anti", "selection_conflicts"}
