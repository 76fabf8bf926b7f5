"""Periodic runs against every lag of every stretch in plain Python."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paneledger.llm import periodic, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(words):
    n, found = len(words), []
    for lag in range(1, n // 4 + 1):
        at = 0
        while at + lag < n:
            end = at
            while end + lag < n and words[end] == words[end + lag]:
                end += 1
            own = words[at:end + lag]
            smaller = any(all(own[x] == own[x + p] for x in range(len(own) - p)) for p in range(1, lag))
            if end > at and len(own) >= max(6, 4 * lag) and not smaller:
                found.append((at, len(own), lag))
            at = max(end, at + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words, runs):
    gone = {x for start, length, period in runs for x in range(start + period, start + length)}
    return " ".join(word for x, word in enumerate(words) if x not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=5))
def test_runs_against_brute_force(parts):
    words = [word for part, times in parts for word in part * times]
    codes = np.array([ord(word) for word in words], np.int64)
    assert [tuple(run) for run in periodic.runs(codes).tolist()] == brute_force(words)


def test_texts_together_are_as_alone(documents):
    texts = [None, "", "  \t\n ", "a a a a a a", "a a a a a", "b " * 5 + "a", "x y " * 4 + "x", "x y z " * 4, "A a " * 6, "é\x0bé\x0cé\ré é é",
             "one two three " * 40 + "end", "k " + "p q r s t " * 5 + "p q " + "z " * 9, "w w " * 6, "w w " * 7]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[10])]
    found = periodic.runs_of(documents(rows), "doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in found:
        words = WORD.findall(row.text or "")
        runs = brute_force(words)
        assert [tuple(run) for run in row.runs] == runs and row.n_words == len(words)
        assert row.collapsed == collapse(words, runs)


def test_collapsed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "la la la la la la la", 7, ["x"]), (2, "no  run", None, None), (3, None, 1, [])],
                                 "doc_id long, text string, runs int, collapsed array<string>")
    left = periodic.collapsed(docs)
    assert left.schema == docs.schema
    assert sorted(left.collect()) == sorted([(1, "la", 7, ["x"]), (2, "no  run", None, None), (3, None, 1, [])])


def test_empty_table(documents):
    assert periodic.runs_of(documents([]), "doc_id").collect() == []
    assert periodic.collapsed(documents([])).collect() == []


def test_clashing_names_are_refused(documents):
    import pytest

    with pytest.raises(ValueError, match="runs"):
        periodic.runs_of(documents([]).withColumn("runs", F.lit(1)), "runs")


def test_long_texts_take_no_square_time():
    n = 200_000
    texts = [[b"a"] * n, [b"%d" % (bin(i).count("1") & 1) for i in range(n)], [b"%d" % (i % 777) for i in range(n)]]
    start = time.perf_counter()
    found = periodic._runs_of_texts(texts)
    assert [run.tolist() for run in found] == [[[0, n, 1]], [], [[0, n, 777]]]
    assert time.perf_counter() - start < 20


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_force(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(collapse(words, runs)))


def test_query_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.expr("substring(text, 1, 700)"))
    docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "repeat(substring(text, 1, doc_id % 40), 9) AS text", "lang", "source", "n_chars")).write.parquet(
        str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted(tuple(row[c] for c in columns) for row in registry.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert found == sorted(expected(row.doc_id, row.text) for row in docs.collect())
    assert sum(row[1] for row in found) > 100
