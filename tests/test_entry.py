"""Registered queries against their SQL counterparts in DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from paneledger import WatermarkSpec
from paneledger.plans import compare
from paneledger.plans.commands import run_named

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(entry_module.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def test_every_key_is_registered():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    answer = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in answer.fetchall())
    assert found == expected


def test_contract_queries(spark):
    replay = entry_module.queries()["replay_equal"](spark, FOLDER).collect()
    assert all(r.left_rows == r.right_rows > 0 and r.only_left == r.only_right == 0 for r in replay)


def test_named_run_and_profile_total(spark):
    run = run_named(spark, FOLDER, "events_in_order")
    assert run.counters.first().total == 1000 and run.summary.first().clean
    matrix = compare.profile_matrix(compare.index_named(spark, FOLDER, ["orders"]), {"bounded": WatermarkSpec("bounded", bound_ms=1_000)})
    total = compare.profile_total(matrix).first()
    assert (total.runs, total.findings) == (1, 0)


def test_archive_keeps_its_order_whatever_files_the_events_lie_in(spark, duck, tmp_path):
    path = str(tmp_path / "events.parquet")
    far = "IF(event_id < 400, event_id, event_id + 50000) AS event_id"
    events = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr(far, "ts", "event_type")
    events.orderBy("event_type").repartition(4, "event_type").write.parquet(path)
    duck.execute(f"CREATE TEMP VIEW scattered AS SELECT * FROM '{path}/*.parquet'")
    expected = duck.execute(entry_module.oracle_sql()["feed_archive"].replace("FROM events", "FROM scattered")).fetchall()
    found = [tuple(r) for r in entry_module.feed_archive(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 531
