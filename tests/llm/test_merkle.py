"""Manifests against the whole tree, built leaf by leaf in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paneledger.llm import merkle
from paneledger.llm.merkle import Block, copied, hashed

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, source, lang, n_chars, _ = row
    return sha("".join(map(counted, [doc_id, source, lang, n_chars, text])))


def level_up(nodes):
    return [sha("".join(nodes[at:at + 3])) for at in range(0, len(nodes), 3)]


def way(nodes, at):
    """The siblings of node ``at`` on its way up, each with its place."""
    steps = []
    while len(nodes) > 1:
        run, place = nodes[at - at % 3:at - at % 3 + 3], at % 3
        steps.append((place, run[:place] + run[place + 1:]))
        nodes, at = level_up(nodes), at // 3
    return steps, nodes[0]


def brute_force(rows, tampered):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    for name in names:
        groups[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf_of(row, row[4])))
    trees = {name: [leaf_of(row, row[4]) for row in groups[name]] for name in names}
    subroots = [way(trees[name], 0)[1] for name in names]
    found = []
    for place, name in enumerate(names):
        upper, root = way(subroots, place)
        for at, row in enumerate(groups[name]):
            own, subroot = way(trees[name], at)
            folded = leaf_of(row, tampered(row))
            for where, others in own + upper:
                folded = sha("".join([*others[:where], folded, *others[where:]]))
            proof = sha("".join(other for _, others in own + upper for other in others))
            found.append((row[0], trees[name][at], subroot, root, proof, folded, folded == root))
    return sorted(found, key=repr)


def made(n, sources, seed):
    random.seed(seed)
    rows = [(i, random.choice(sources), random.choice(["en", None]), random.choice([None, 5]),
             random.choice([None, "", "one\nline", f"text {i}", "é\n\U0001f600"])) for i in range(n)]
    random.shuffle(rows)
    return rows


CASES = {
    "a lone leaf": [(1, "a", "en", 1, "x")],
    "lone leaves": [(i, f"s{i}", "en", 1, "x\ny") for i in range(5)],
    "two leaves": [(1, "a", "en", 1, "x\n"), (2, "a", "en", 1, "y")],
    "a full block": [(i, "a", None, i, f"t\n{i}") for i in range(243)],
    "one more than a block": [(i, "a", None, i, f"t\n{i}") for i in range(244)],
    "several blocks and sources": made(2_000, [None, "", "=", "a", "b", "hot", "hot", "hot", "hot", "é", "ñ", "\U0001f600"], 1),
    "many sources": made(1_200, [f"source {i}" for i in range(700)], 2),
    "repeated rows and null ids": [(7, "a", "en", 1, "x\n")] * 5 + [(None, "a", "en", 1, "y\n")] * 2 + [(None, None, None, None, None)] * 4 + [(7, "a", "en", 1, "z")],
}


@pytest.mark.parametrize("name", CASES)
def test_versions_against_whole_trees(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    changed = F.when(F.col("doc_id") % 2 == 1, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.build(merkle.leaves(docs, {"text": changed})).versions().collect()

    def tampered(row):
        return row[4].replace("\n", "") if row[0] is not None and row[0] % 2 and row[4] is not None else row[4]

    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(row[c] for c in columns) for row in found], key=repr) == brute_force(rows, tampered)
    assert all((row.n_copied == 0) == row.verified for row in found)


def test_subroots_and_root(spark):
    rows = made(600, [None, "a", "b"], 3)
    manifest = merkle.build(merkle.leaves(spark.createDataFrame(rows, SCHEMA), {}))
    expected = brute_force(rows, lambda row: row[4])
    assert {row.subroot for row in manifest.subroots.collect()} == {row[2] for row in expected}
    assert [row.key for row in manifest.subroots.orderBy("key").collect()] == ["", "=a", "=b"]
    assert manifest.root.first().root == expected[0][3]


def test_empty_table_has_no_root(spark):
    manifest = merkle.build(merkle.leaves(spark.createDataFrame([], SCHEMA), {}))
    assert manifest.root.collect() == [] and manifest.versions().collect() == []


def test_other_columns_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "x", "k", 9, "p")], SCHEMA + ", key string, pos int, path string")
    plain = docs.select("doc_id", "source", "lang", "n_chars", "text")
    assert [r.root for r in merkle.build(merkle.leaves(docs, {})).versions().collect()] == [
        r.root for r in merkle.build(merkle.leaves(plain, {})).versions().collect()]


def test_positions_count_on_across_partitions(spark):
    rows = [("k" if i % 3 else "l", i) for i in range(5_000)]
    nodes = merkle.in_order(spark.createDataFrame(rows, "key string, v int").repartition(8), "v").collect()
    for key in "kl":
        own = sorted((row.v, row.pos) for row in nodes if row.key == key)
        assert [pos for _, pos in own] == list(range(len(own)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 242, 243])
def test_a_version_copies_the_ancestors_only(n):
    leaves = [hashed([b"%d" % i]) for i in range(n)]
    block = Block.of(leaves, whole=True)
    for at in range(n):
        version = copied(hashed([b"other"]), block.path(at))
        whole = Block.of([*leaves[:at], hashed([b"other"]), *leaves[at + 1:]], whole=True)
        assert version[-1] == whole.root
        differing = sum(a != b for old, new in zip(block.levels, whole.levels) for a, b in zip(old, new))
        assert len(version) == differing == len(block.levels)
