from __future__ import annotations

import random

import pytest

from paneledger.llm import set_join
from paneledger.llm.components import components
from paneledger.llm.set_join import join_classes


def shingles(text: str | None) -> frozenset:
    words = text.encode().lower().split() if text else []
    return frozenset(tuple(words[at:at + 5]) for at in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Every pair compared, components by repeated union."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    holders: dict = {}
    for at, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(at)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least: dict = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return [(doc_id, len(own), least.get(g)) for (doc_id, _), own, g in zip(rows, sets, group)]


def compared(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=str)


def made(seed: int) -> list[tuple]:
    """Families of near copies of many sizes around a common passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=14)
    texts = []
    for _ in range(60):
        text = rng.choices(words, k=rng.choice([1, 3, 5, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 25, 40, 120]))
        if rng.random() < 0.4:
            text = passage + text
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                change = rng.choice(["replace", "drop", "end"])
                at = rng.randrange(len(copy))
                if change == "replace":
                    copy[at] = rng.choice(words)
                elif change == "drop" and len(copy) > 1:
                    del copy[at]
                else:
                    copy += rng.choices(words, k=rng.randint(1, 3))
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, documents, seed):
    rows = made(seed)
    assert compared(join_classes(documents(rows))) == sorted(brute_force(rows), key=str)


def test_lists_alone_and_subsets_alone(spark, documents, monkeypatch):
    rows = made(3)
    expected = sorted(brute_force(rows), key=str)
    for boundary in (0, 14):
        monkeypatch.setattr(set_join, "boundary_of", lambda sizes, boundary=boundary: boundary)
        assert compared(join_classes(documents(rows))) == expected


def test_odd_rows(spark, documents):
    long = " ".join(f"x{k % 977}y{k}" for k in range(40_000))
    rows = [(5, None), (6, ""), (7, " \n"), (3, "a b"), (2, "A  B"), (None, "a b"), (9, "a b c d e"), (9, "a b c d e"),
            (None, "q r s t u v"), (8, long), (1, long + " z"), (4, "a\xa0b c"), (11, "a\xa0b c")]
    assert compared(join_classes(documents(rows).selectExpr("*", "1 AS row_key", "2 AS node"))) == sorted(brute_force(rows), key=str)
    assert join_classes(documents([])).collect() == []


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    assert compared(join_classes(docs)) == sorted(brute_force(rows), key=str)


def test_boundary_follows_cost():
    assert set_join.boundary_of({}) == 0
    assert 4 <= set_join.boundary_of({k: 10 for k in range(1, 33)}) < set_join.LARGEST_BOUNDARY


def test_components(spark):
    path = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 7), (9, 3), (50, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
