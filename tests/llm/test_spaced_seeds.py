from __future__ import annotations

import random
from itertools import combinations

import pytest

from paneledger.llm import spaced_seeds
from paneledger.llm.registry import queries
from paneledger.llm.spaced_seeds import ENOUGH, MASKS, SHORTEST, WINDOW, decontaminated, overlaps


def words_of(text):
    return text.encode().lower().split() if text else []


def brute_force(docs, items) -> dict:
    """Every shift of every item over every document."""
    found = {}
    for row, (doc_id, text) in enumerate(docs):
        words = words_of(text)
        for key, (item_id, item_text) in enumerate(items):
            item = words_of(item_text)
            if len(item) < SHORTEST:
                continue
            need, size = (ENOUGH, WINDOW) if len(item) >= WINDOW else (len(item), len(item))
            best = None
            for shift in range(-len(item), len(words)):
                same = [words[p] == item[p - shift] for p in range(max(0, shift), min(len(words), shift + len(item)))]
                good = [at for at in range(len(same) - size + 1) if sum(same[at:at + size]) >= need]
                if good:
                    agree = [at for at in range(good[0], good[-1] + size) if same[at]]
                    here = (agree[-1] - agree[0] + 1, len(agree), -(max(0, shift) + agree[0]))
                    best = max(best or here, here)
            if best:
                found[(row, key)] = (doc_id, item_id, -best[2], best[0], best[1])
    return found


@pytest.fixture
def benchmark_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_masks_hit_every_window():
    shown = [{at for at, seen in enumerate(mask) if seen == "1"} for mask in MASKS]
    for changed in combinations(range(WINDOW), WINDOW - ENOUGH):
        assert any(not ({at + k for k in ones} & set(changed)) for mask, ones in zip(MASKS, shown) for at in range(WINDOW - len(mask) + 1))
    assert len(MASKS[0]) <= SHORTEST  # an unchanged item always shows this mask


def test_as_brute_force(spark, documents, benchmark_of):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 7, 8, 12, 13, 20, 45])))) for k in range(25)]
    docs = []
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        item = rng.choice(items)[1].split()
        if item and rng.random() < 0.7:
            low = rng.randrange(len(item))
            part = item[low:] if rng.random() < 0.5 else item
            part = [rng.choice(vocabulary) if rng.random() < 0.1 else word.upper() for word in part]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((k, " ".join(words)))
    expected = brute_force(docs, items)
    assert len(expected) > 15
    got = {(row.doc_id, row.item_id): tuple(row)[1:] for row in overlaps(documents(docs), benchmark_of(items)).collect()}
    assert got == {key: value for key, value in expected.items()}


def test_odd_rows(spark, documents, benchmark_of):
    passage = " ".join(f"t{k}" for k in range(20))
    long = " ".join(f"x{k}" for k in range(100_000))
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, "a b " + passage), (4, long + " " + passage), (5, "t0 t1 t2"), (6, long)]
    items = [(7, passage), (7, passage), (None, "q " + passage), (8, None), (9, "")]
    frame = documents(docs).selectExpr("*", "1 AS start", "'x' AS row_key", "2 AS _maybe2")
    got = sorted(((row.doc_id, row.item_id, row.start, row.n_words) for row in overlaps(frame.drop("row_key"), benchmark_of(items)).collect()), key=str)
    assert len(got) == 4 * 3 and {row[0] for row in got} == {3, None, 4} and {row[3] for row in got} == {20}
    left = decontaminated(frame, benchmark_of(items))
    assert left.columns == frame.columns and sorted((row.doc_id for row in left.collect()), key=str) == [1, 2, 5, 6]
    assert overlaps(documents([]), benchmark_of(items)).collect() == []
    assert decontaminated(frame, benchmark_of([])).count() == len(docs)


def test_query(spark, small):
    docs = [(row.doc_id, row.text) for row in spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").collect()]
    items = [(row.item_id, row.text) for row in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = {value[:2] for value in brute_force([d for d in docs if len(d[1]) < 3000], items).values()}
    got = {(row.doc_id, row.item_id) for row in queries()["op10_decontamination"](spark, small).collect()}
    short = {doc_id for doc_id, text in docs if len(text) < 3000}
    assert {pair for pair in got if pair[0] in short} == expected
    assert spaced_seeds.SPAN == 10
