from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from paneledger.llm import brown
from paneledger.llm.registry import queries


def words_of(text):
    return text.encode().lower().split() if text else []


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_base(rows) -> list[tuple]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        if doc_id is not None and not held(doc_id):
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[token] + 1) / (n + v + 1)) for token in tokens)
        out.append((doc_id, held(doc_id), len(tokens), sum(counts[token] > 0 for token in tokens), n, base))
    return out


def made(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    kinds = [[f"{a}{k}" for k in range(25)] for a in ("noun", "verb", "Adj")]
    return [(k, " ".join(rng.choice(kinds[at % 3]) for at in range(rng.randint(0, 60)))) for k in range(n)]


def compared(got, rows):
    got = sorted(map(tuple, got), key=str)
    expected = sorted(plain_base(rows), key=str)
    assert [row[:5] for row in got] == [row[:5] for row in expected]
    assert np.allclose([row[5] for row in got], [row[5] for row in expected], rtol=1e-9)


@pytest.mark.parametrize("most", [0, 10, 200_000])
def test_base_and_probabilities(spark, documents, monkeypatch, most):
    monkeypatch.setattr(brown, "MOST_FREQUENT", most)
    rows = made(1)
    compared(brown.scores(documents(rows)).collect(), rows)


def test_probabilities_sum_to_one(spark, documents):
    """Over every next word: the known ones, one unknown word per class, and the end."""
    docs = documents(made(2))
    model, counts = brown.learn(docs)
    words = sorted({word.decode() for doc_id, text in made(2) if not held(doc_id) for word in words_of(text)})
    assert np.allclose((10 ** model.transitions).sum(axis=1), 1)
    probes = documents([(k, word) for k, word in enumerate(words)])
    score = {row.doc_id: row.score for row in brown.scored(probes, model, counts).collect()}
    ends = model.transitions[:, brown.CLASSES]
    by_word = {row.doc_id: row for row in brown.scored(documents([(0, "")]), model, counts).collect()}
    total, classes = 10 ** by_word[0].score, {}
    hashes = brown.words_of(__import__("pyarrow").array(words))
    for block in hashes:
        classes = dict(enumerate(model.classes[model.units.of(block, block.hashes())]))
    for k, c in classes.items():
        total += 10 ** (score[k] - ends[c])
    for c in range(brown.CLASSES):
        total += 10 ** model.transitions[brown.CLASSES, c] * brown.DELTA * 10 ** model.shares[c]
    assert abs(total - 1) < 1e-9


def test_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(0)
    bigrams = rng.integers(5, 50, (6, 6)).astype(float)
    before, after = rng.integers(0, 3, 6).astype(float), rng.integers(0, 3, 6).astype(float)
    for own in range(6):
        gain = brown.gains(bigrams, before, after, own)
        for other in range(6):
            if other != own:
                moved = bigrams.copy()
                moved[own] -= after
                moved[other] += after
                moved[:, own] -= before
                moved[:, other] += before
                assert abs(brown.likelihood(moved) - brown.likelihood(bigrams) - gain[other]) < 1e-8


def test_classes_help(spark, documents):
    rows = made(3, 300)
    got = brown.scores(documents(rows)).collect()
    unseen = [row for row in got if row.held_out]
    assert sum(row.score for row in unseen) > sum(row.base_score for row in unseen)
    assert len(unseen) > 20


def test_gains_of_many_words():
    rng = np.random.default_rng(1)
    bigrams = rng.integers(60, 200, (7, 7)).astype(float)
    near = rng.integers(0, 4, (40, 2, 7)) * rng.integers(0, 2, (40, 2, 7))
    near[0, 1, 3], near[:, 0, 0] = 30, 1
    key = np.repeat(np.arange(near.size), near.ravel())
    own = rng.integers(0, 6, 40)
    best, gain = brown.best_classes(key, own, bigrams, brown._at_hand(bigrams))
    for k in range(40):
        expected = brown.gains(bigrams, near[k, 0], near[k, 1], own[k])
        expected[-1] = -np.inf
        assert abs(gain[k] - expected.max()) < 1e-8 and abs(expected[best[k]] - expected.max()) < 1e-8


@pytest.mark.parametrize("at_once", [40, 4_000_000])
def test_words_outside_the_head_are_exchanged(spark, documents, monkeypatch, at_once):
    """Words of three kinds that all end alike, so that their group says nothing."""
    monkeypatch.setattr(brown, "UNITS", 30)
    monkeypatch.setattr(brown, "_WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(brown, "_CELLS_AT_ONCE", at_once * 8)
    rows = [(k, " ".join(word + "end" for word in text.split())) for k, text in made(4, 400)]
    model, counts = brown.learn(documents(rows))
    words = sorted({word.decode() for doc_id, text in rows if not held(doc_id) for word in words_of(text)})
    block, = brown.words_of(__import__("pyarrow").array(words))
    classes = model.classes[model.units.of(block, block.hashes())]
    kinds = {kind: Counter(c for word, c in zip(words, classes) if word.startswith(kind)) for kind in ("noun", "verb", "adj")}
    alone = sum(n for kind, own in kinds.items() for c, n in own.items() if not any(c in other for name, other in kinds.items() if name != kind))
    assert len(words) == 75 and len(model.units.tail) == 45 and alone >= 70
    got = [row for row in brown.scored(documents(rows), model, counts).collect() if row.held_out]
    assert sum(row.score - row.base_score for row in got) > 0.3 * sum(row.n_tokens for row in got)


def test_neighbours_are_summed_by_parts(spark, monkeypatch):
    """Counts below and above a byte, from several tasks; the parts of the table are rows, not its cells."""
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, 40, 3000) ** 3 // 1600, 40).astype("<i4") for _ in range(9)]
    rows = [(text.tobytes(),) for text in texts]
    ids = spark.createDataFrame(rows, "ids binary").repartition(3)
    expected, classes = np.zeros((2, 41, 6)), np.append(np.arange(40) % 5, 5)
    for text in texts:
        for before, after in zip([40, *text[:-1]], text):
            expected[0, after, classes[before]] += 1
            expected[1, before, classes[after]] += 1
    assert expected.max() > 256
    handed_on, plain = [], type(ids).toArrow
    monkeypatch.setattr(type(ids), "toArrow", lambda frame: handed_on.append(plain(frame)) or handed_on[-1])
    assert (brown.neighbours(ids, 40, np.arange(41), classes, 41, 6) == expected).all()
    assert handed_on[0].column_names == ["part", "n"] and handed_on[0].num_rows <= brown._PARTS_OF_CELLS


def test_group_of_a_word_whatever_its_case(spark, documents):
    """Every word is in one class, and tokens and words of the classes are those of the counts."""
    block, = brown.words_of(__import__("pyarrow").array(["Foo FOO foo fOo"]))
    assert len(set(brown.suffix_of(block, brown.SUFFIXES).tolist())) == 1
    docs = documents([(k, f"Word{k} wORD{k} ENDS{k} thing") for k in range(40)])
    model, counts = brown.learn(docs)
    sums = brown._class_sums(counts, model.units, model.classes, len(model.transitions))
    words = [word for k in range(40) if not held(k) for word in (f"word{k}", f"word{k}", f"ends{k}", "thing")]
    assert sums[:, 0].sum() == len(words) and sums[:, 1].sum() == len(set(words))


def test_classes_grow_with_words():
    assert brown.class_number(75) == 32 and brown.class_number(10 ** 6) == 63 and brown.class_number(10 ** 8) == 200


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "a b c"), (4, "Same  TEXT\n\xa0 é"), (5, "x y " * 60_000)]
    frame = documents(rows).selectExpr("*", "1 AS row_key", "2 AS score", "3 AS n")
    compared(brown.scores(frame.drop("row_key")).collect(), rows)
    assert brown.scores(documents([])).collect() == []
    compared(brown.scores(documents([(None, "a"), (None, None)])).collect(), [(None, "a"), (None, None)])


def test_query(spark, small):
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries()["op7_brown_score"](spark, small).collect()
    compared(got, rows)
    unseen = [row for row in got if row.held_out]
    assert sum(row.score for row in unseen) > sum(row.base_score for row in unseen)
