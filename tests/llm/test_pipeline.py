from __future__ import annotations

import importlib
import sys

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from paneledger.llm import bpe, quality
from paneledger.llm.surrogates import detected

sys.path.insert(0, __file__.rsplit("/", 1)[0])
test_set_join = importlib.import_module("test_set_join")
test_spaced_seeds = importlib.import_module("test_spaced_seeds")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage over the smallest documents, stored and read again."""
    folder, at = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, results[-1], folder).write.parquet(f"{at}/{number}")
        results.append(spark.read.parquet(f"{at}/{number}"))
    return results


def texts(frame):
    return {row.doc_id: row.text for row in frame.collect()}


def test_quality(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    labels = {row.doc_id: row.quality for row in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    failed = {k for k, text in before.items() if quality.base_failed(quality.described(text)[0])}
    assert not failed & set(after)
    wrong = [k for k, good in labels.items() if (k in after) != (good == 1 and k not in failed)]
    assert all(k in after for k, good in labels.items() if good == 1 and k not in failed) and len(wrong) <= 6  # few labels to learn from
    assert stages[1].columns == stages[0].columns and all(before[k] == text for k, text in after.items())


def test_one_of_each_group(stages):
    rows = [(row.doc_id, row.text) for row in stages[1].collect()]
    kept = {component for _, _, component in test_set_join.brute_force(rows)}
    assert texts(stages[2]) == {k: text for k, text in rows if k in kept} and len(kept) < len(rows)


def test_no_benchmark_passage(spark, stages):
    rows = [(row.doc_id, row.text) for row in stages[2].collect()]
    items = [(row.item_id, row.text) for row in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    sets = [set(test_spaced_seeds.words_of(text)) for _, text in items]
    leaks = set()
    for k, text in rows:  # an overlap of 10 of 13 words shares at least 4 different ones
        own = set(test_spaced_seeds.words_of(text))
        near = [item for item, words in zip(items, sets) if len(words & own) >= 4]
        if len(text) < 6_000 and test_spaced_seeds.brute_force([(k, text)], near):
            leaks.add(k)
    left = texts(stages[3])
    assert set(left) == {k for k, text in rows if k not in leaks} or all(len(dict(rows)[k]) >= 6_000 for k in set(dict(rows)) - leaks - set(left))
    assert not leaks & set(left)


def test_personal_data_and_ids(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for k, text in before.items():
        spans = detected(text)
        assert (after[k] == text) == (not spans)
        assert [kind for _, _, kind, _ in detected(after[k])] == [kind for _, _, kind, _ in spans]
        assert all(text[start:end] not in after[k] for start, end, _, _ in spans)
    with open(corpus_pipeline.RANKS, "rb") as file:
        library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(file.read()), special_tokens={})
    assert all(row.ids == library.encode_ordinary(row.text) for row in stages[5].collect())


def test_ids_are_decoded_again(spark, stages):
    """Every row has the bytes of its ids, whatever columns it had."""
    rows = stages[5].collect()
    assert rows and stages[5].columns == [*stages[4].columns, "ids", "decoded"]
    assert all(bytes(row.decoded) == row.text.encode() for row in rows)
    docs = spark.createDataFrame([(1, "é  of\n12 \u3000x", 5), (1, None, 6), (None, "", 7)], "doc_id long, text string, decoded int")
    got = corpus_pipeline.encoded(spark, docs, "").collect()
    assert sorted((row.decoded, bytes(row.decoded_)) for row in got) == [(5, "é  of\n12 \u3000x".encode()), (6, b""), (7, b"")]


def test_run_is_the_stages(spark, small, stages):
    assert sorted(corpus_pipeline.run(spark, small).select("doc_id", "ids").collect()) == sorted(stages[5].select("doc_id", "ids").collect())


def test_odd_rows(spark, small):
    good = " ".join(f"the{k % 90} of and thing{k}." for k in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (None, "The " + good), (4, good.replace("thing", "ring") + " mail a@b.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "1 AS row_key", "'x' AS node")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, small)
        assert result.columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), small).collect() == []
    assert sorted(row.doc_id or 0 for row in corpus_pipeline.distinct(spark, docs, small).collect()) == [1, 2, 3, 4]
    assert "a@b.org" not in str(corpus_pipeline.private(spark, docs, small).collect())


def test_long_personal_data_ends(spark):
    """Addresses and secrets of many letters: their stage took no end of time."""
    long = ["maximilian.featherstonehaugh@international-consulting.example.com", "konstantina.papadopoulou@verwaltungsgericht-nord.example.org"]
    docs = spark.createDataFrame([(k, f"write to {long[k % 2]} or use token={'Ab3Kd' * (20 + k)}") for k in range(6)], "doc_id long, text string")
    got = texts(corpus_pipeline.private(spark, docs, ""))
    assert len(set(got.values())) == 6
    for text in got.values():
        assert not any(one in text for one in long) and "Ab3Kd" not in text
        assert [kind for _, _, kind, _ in detected(text)] == ["email", "secret"]
    assert len({text.split()[2] for text in got.values()}) == 2


def test_columns_named_like_helpers_stay(spark, small):
    """No stage overwrites a user's column, whatever its name."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["_row_key", "row_key", "maybe", "tried", "ids", "decoded", "node"]
    named = docs.selectExpr("*", *[f"doc_id * 10 + {k} AS {name}" for k, name in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, named, small)
        found = out.select("doc_id", *names).collect()
        assert found and all(row[n] == row.doc_id * 10 + k for row in found for k, n in enumerate(names)), name
        assert out.columns[:len(named.columns)] == named.columns
