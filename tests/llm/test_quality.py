from __future__ import annotations

import re

import numpy as np
import pytest

from paneledger.llm import quality
from paneledger.llm.registry import queries


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[at:at + 3]) for at in range(len(words) - 2)]
    covered = {at + k for at, window in enumerate(windows) if windows.count(window) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a a", "a b c d a b c", "x\x0by\x0cz\r\nx\x0by\x0cz\r\n\n\n", "# * é $%&|<>",
         "日本 語\xa0x  y\x1cz", "line\nline\n line\nline ", "w " * 60, " ".join(f"w{k}" for k in range(60))]


def test_base_counts(spark, documents):
    trees = quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0), list(quality.FEATURES.values()))
    rows = quality.judge(documents(list(enumerate(TEXTS))).selectExpr("*", "1 AS score", "true AS kept"), trees).collect()
    for row, text in zip(sorted(rows), TEXTS, strict=True):
        counts = plain_counts(text)
        assert tuple(row[1:6]) == counts, repr(text)
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert row.kept == (not row.base_failed)
    assert quality.judge(documents([]), trees).collect() == []


def test_whole_long_text(spark, documents):
    text = " ".join(f"w{k}" for k in range(200_000)) + "\nend end end end"
    trees = quality.Trees(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)), 10.0)
    row = quality.judge(documents([(None, text)]), trees).collect()[0]
    assert (row.n_words, row.n_repeat_words) == (200_004, 4)


def test_trees_learn_and_obey_constraints():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(float)
    free = quality.grow(x, y, [0, 0, 0])
    assert ((free.score(x) >= 0.5) == y).mean() > 0.95
    bound = quality.grow(x, (x[:, 0] + rng.normal(0, 0.3, 3000) > 0.5).astype(float), [1, 0, -1])
    line = np.linspace(0, 1, 101)
    for other in rng.uniform(size=(20, 2)):
        rising = bound.score(np.column_stack([line, np.full(101, other[0]), np.full(101, other[1])]))
        falling = bound.score(np.column_stack([np.full(101, other[0]), np.full(101, other[1]), line]))
        assert (np.diff(rising) >= -1e-12).all() and (np.diff(falling) <= 1e-12).all()


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents([(1, " ".join(f"w{k}" for k in range(60))), (2, "short"), (None, None)])
    for labels in ([], [(1, 1), (2, None), (None, 0)], [(1, 1), (1, 1), (9, 0)]):
        trees = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [row.kept for row in sorted(quality.judge(docs, trees).collect(), key=str)] in ([True, False, False], [False, True, False])
    extra = docs.selectExpr("text AS kept", "doc_id", "text", "1 AS score")
    assert quality.keep_good(extra, trees).collect() == [row for row in extra.collect() if row.doc_id == 1]


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_held_out_labels(spark, small, folder):
    """Documents that the sample leaves out are judged as labelled."""
    path = small.replace("sf0.001", folder)
    docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    trees = quality.train(docs, labels, sample=250)
    used = {row.doc_id for row in quality.sampled(labels.select("doc_id", "quality").distinct(), ["doc_id", "quality"], 250).collect()}
    judged = {row.doc_id: row for row in quality.judge(docs, trees).collect()}
    right = [(judged[row.doc_id].score >= 0.5) == (row.quality > 0) for row in labels.collect() if row.doc_id not in used]
    assert len(right) > 80 and sum(right) > 0.97 * len(right)


def test_query(spark, small):
    rows = queries()["op1_quality_rules"](spark, small).collect()
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(tuple(row[1:6]) == plain_counts(texts[row.doc_id]) for row in rows if len(texts[row.doc_id]) < 5000)
