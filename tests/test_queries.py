"""Every query against its SQL, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from athletrack.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


def test_batch_and_stream_tracks_agree(spark, sf_dir):
    batch, stream = QUERIES["track_sessions"](spark, sf_dir), QUERIES["track_stream"](spark, sf_dir)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))


@pytest.mark.parametrize("name", ["track_long_sessions", "track_unordered"])
def test_other_forms_of_the_fold_agree(spark, sf_dir, name):
    assert sorted(map(str, QUERIES["track_sessions"](spark, sf_dir).collect())) == sorted(map(str, QUERIES[name](spark, sf_dir).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_identities(spark, sf_dir):
    rows = QUERIES["session_throughput"](spark, sf_dir).collect()
    assert all(r["captured"] <= r["processed"] + r["skipped"] for r in rows)
    rows = QUERIES["detector_worker_stats"](spark, sf_dir).where("scope = 'all'").collect()
    assert all(r["completed"] <= r["submitted"] for r in rows)
    rows = QUERIES["edge_actionable_split"](spark, sf_dir).collect()
    assert all(r["events"] == r["suppressed"] + r["actionable"] for r in rows)
