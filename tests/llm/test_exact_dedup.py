"""Exact copies against grouping by text in plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from paneledger.llm import exact_dedup

CASES = [
    (5, "alpha"), (9, "alpha"), (2, "beta"), (None, "beta"), (7, None), (3, ""), (1, "Alpha"), (4, "gamma "), (6, "gamma"),
    (8, "x" * 300_000), (10, "x" * 300_000), (None, None), (11, "ünïcode \U0001f600"), (12, "ünïcode \U0001f600"), (None, "delta"), (None, "delta"),
    (13, "same"), (13, "same"), (13, "same")]


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        stays = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(doc_id, stays, len(ids), sha) for doc_id in ids]
    return sorted(found, key=repr)


def check(df, rows, **options):
    found = exact_dedup.copies(df, **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=repr) == brute_force(rows)
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({text or "" for _, text in rows})


@pytest.mark.parametrize("most", [1, 2, 1_024])
def test_cases(documents, most):
    check(documents(CASES), CASES, most=most)


def test_hot_group_and_many_small_ones(documents):
    rows = [(i, "hot") for i in range(0, 3_000, 2)] + [(i, f"text {i // 7}") for i in range(1, 3_000, 2)]
    check(documents(rows).repartition(16), rows, tracked=64, most=4)


def test_counters_find_every_frequent_digest(documents):
    rows = [(i, f"frequent {i % 5}" if i % 2 else f"rare {i}") for i in range(8_000)]
    table = exact_dedup.digests(documents(rows).repartition(8))
    often = {bytes(r.digest) for r in exact_dedup.winners(table, tracked=256, most=16).collect()}
    assert {hashlib.sha256(f"frequent {k}".encode()).digest() for k in range(5)} <= often


def test_winners_are_counted_exactly(documents):
    rows = [(i, f"frequent {i % 3}" if i % 4 else f"rare {i}") for i in range(4_000)]
    table = exact_dedup.digests(documents(rows).repartition(8))
    sizes = {bytes(r.digest): r.group_size for r in exact_dedup.winners(table, tracked=128, most=8).collect()}
    for k in range(3):
        assert sizes[hashlib.sha256(f"frequent {k}".encode()).digest()] == sum(1 for i, t in rows if t == f"frequent {k}")


def test_empty_table(documents):
    assert exact_dedup.copies(documents([])).collect() == []
    assert exact_dedup.one_of_each(documents([])).collect() == []


def test_one_of_each_keeps_all_columns(spark):
    rows = [(doc_id, text, i, "d", [i]) for i, (doc_id, text) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key long, digest string, own_key array<int>")
    left = exact_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    found = left.collect()
    assert len(found) == len({text or "" for _, text in CASES})
    best = {}
    for doc_id, text in CASES:
        best[text or ""] = max(best.get(text or "", -1), -1 if doc_id is None else doc_id)
    for row in found:
        assert best[row.text or ""] == (-1 if row.doc_id is None else row.doc_id)
        assert rows[row.row_key][:2] == (row.doc_id, row.text) and row.own_key == [row.row_key]


def test_normal_form(documents):
    from pyspark.sql import functions as F

    rows = exact_dedup.copies(documents([(1, "A b"), (2, "a B"), (3, "ab")]), form=F.lower).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_plan_has_no_python(documents):
    plan = exact_dedup.copies(documents(CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
