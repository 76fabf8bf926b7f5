"""A Merkle manifest of a dataset, and a version of it for every tampered row.

Every row is a leaf; the leaves of a group, in order, and then the groups' own roots, in
order, are hashed up in runs of three. The tree is persistent: a tampered leaf makes a
version that shares all nodes with the tree it comes from but the copied ancestors of
that leaf. Trees are cut into aligned blocks of 3 ** LEVELS leaves, each the whole of one
subtree (or the ragged end of a level), so a block is hashed, and its versions are copied
along their paths, where its leaves lie; the nodes on top of the blocks are the leaves of
the next round, until one is left. On the way down every block gets the siblings above
it, one row a block, and each version goes on through them to a root of its own.

Rows are numbered by a range shuffle over (group, order), which cuts groups of any size
into partitions; a partition counts on from those before it by a table that has one row
a partition at most. What is stored and shuffled of a row is its digests and its id.
A group, however large, is spread by its blocks; a task holds one block at a time.

Cases: a null value is hashed as ``-``, unlike any other value; rows without a group are
a group of their own, the first; null ids come first in their group, and rows with equal
ids are ordered by their leaves; repeated rows are leaves of their own; an empty table
has no root and gives an empty result; columns that are not hashed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneledger.workspace import keep

WIDTH, LEVELS = 3, 5
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at: int, others: array<string>>>"
# One step up: the place in its run, and the run's other nodes, left to right.
Step = tuple[int, list[bytes]]


def hashed(parts: list[bytes]) -> bytes:
    """H: lowercase hex of the SHA-256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


@dataclass
class Block:
    """The nodes of a block, level by level, as hex; the last level has one node."""

    levels: list[list[bytes]]

    @classmethod
    def of(cls, nodes: list[bytes], whole: bool) -> Block:
        """The tree of the nodes: up to the one that is left, or LEVELS up if the block
        is one of several (a run of one is hashed like any other)."""
        levels = [nodes]
        while len(levels) <= LEVELS if not whole else len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([hashed(below[at:at + WIDTH]) for at in range(0, len(below), WIDTH)])
        return cls(levels)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[Step]:
        """The steps from leaf ``at`` to the root of the block."""
        steps = []
        for nodes in self.levels[:-1]:
            start = at - at % WIDTH
            run = nodes[start:start + WIDTH]
            steps.append((at - start, run[:at - start] + run[at - start + 1:]))
            at //= WIDTH
        return steps


def copied(leaf: bytes, path: list[Step]) -> list[bytes]:
    """The ancestors of ``leaf`` in its version, from below: all that the version does
    not share. The last one is its root; a leaf alone is its own."""
    nodes = [leaf]
    for at, others in path:
        nodes.append(hashed([*others[:at], nodes[-1], *others[at:]]))
    return nodes


def encoded(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row over ``columns``, some of them ``changed``."""
    values = [(changed or {}).get(c, F.col(f"`{c}`")) for c in columns]
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def leaves(docs: DataFrame, changed: dict[str, Column], group: str = "source", order: str = "doc_id",
           columns: tuple[str, ...] = HASHED) -> DataFrame:
    """``(key, doc_id, digest, changed)`` for every row, stored: its group, its leaf, and
    its leaf if the columns are ``changed``, null where that is the same."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    digests = docs.select(key.alias("key"), F.col(f"`{order}`").alias("doc_id"), leaf(columns).alias("digest"), leaf(columns, changed).alias("changed"))
    return keep(digests.withColumn("changed", F.expr("nullif(changed, digest)")), "leaves")


def in_order(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with their position ``pos`` in their ``key``, from 0, stored."""
    sort = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    ranged = nodes.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id())
    schema = ranged.withColumn("pos", F.lit(0).cast("long")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows = batch.column("key"), np.arange(batch.num_rows)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            starts = np.maximum.accumulate(np.where(new, rows, -1))
            pos = np.where(starts < 0, seen + rows, rows - starts)
            last, seen = keys[-1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], [*batch.schema.names, "pos"])

    numbered = keep(ranged.mapInArrow(number, schema), "ordered")
    counts = numbered.groupBy("key", "part").agg((F.max("pos") + 1).alias("n"))
    before = counts.selectExpr("key", "part", "sum(n) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    # Only the first key of a partition may go on from an earlier one: a row a partition at most.
    carried = F.broadcast(before.where("before > 0"))
    return numbered.join(carried, ["key", "part"], "left").withColumn("pos", F.expr("pos + coalesce(before, 0)")).drop("part", "before")


def _by_blocks(rows: DataFrame, run: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over the rows (key, pos, ...) of each block, in order of ``pos``."""
    wide = rows.withColumn("block", F.expr(f"pos DIV {WIDTH ** LEVELS}")) if "block" not in rows.columns else rows
    sort = ["key", "block", "pos"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ends = _ends(batch)
            for start, end in zip([0, *ends], [*ends, batch.num_rows]):
                if held and start < end and _name(held[0]) != _name(batch.slice(start, 1)):
                    yield run(pa.Table.from_batches(held))
                    held = []
                if start < end:
                    held.append(batch.slice(start, end - start))
        if held:
            yield run(pa.Table.from_batches(held))

    return wide.repartition("key", "block").sortWithinPartitions(*sort).mapInArrow(blocks, schema)


def _ends(batch: pa.RecordBatch) -> list[int]:
    """Where in the batch a block ends and the next begins."""
    if batch.num_rows < 2:
        return []
    other = [pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]) for c in ("key", "block")]
    return (np.flatnonzero(pc.or_(*other).to_numpy(zero_copy_only=False)) + 1).tolist()


def _name(batch: pa.RecordBatch) -> tuple:
    return batch.column("key")[0].as_py(), batch.column("block")[0].as_py()


def _nodes(rows: pa.Table) -> list[bytes]:
    return [digest.hex().encode() for digest in rows.column("digest").to_pylist()]


def _block_of(rows: pa.Table) -> Block:
    """The first block of a key is the whole tree unless it is full, and a full block
    has LEVELS levels either way; every other block is one of several."""
    return Block.of(_nodes(rows), whole=rows.column("block")[0].as_py() == 0)


def _tops(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks, as nodes of the next round."""
    def top(rows: pa.Table) -> pa.RecordBatch:
        root = bytes.fromhex(_block_of(rows).root.decode())
        return pa.RecordBatch.from_pydict({
            "key": pa.array([rows.column("key")[0].as_py()], pa.string()), "pos": pa.array([rows.column("block")[0].as_py()], pa.int64()),
            "digest": pa.array([root], pa.binary())})

    return keep(_by_blocks(nodes.select("key", "pos", "digest"), top, "key string, pos long, digest binary"), "nodes")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round; in the last, every key has one node, its root."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("pos")).first()[0] or 0) > 0 or len(rounds) == 1:
        rounds.append(_tops(rounds[-1]))
    return rounds


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes``, and before each block of them one row with the path from its root up."""
    blocks = nodes.withColumn("block", F.expr(f"pos DIV {WIDTH ** LEVELS}"))
    return blocks.unionByName(above.selectExpr("key", "pos AS block", "-1L AS pos", "path", "subroot"), allowMissingColumns=True)


def _steps(path: list[dict]) -> list[Step]:
    return [(step["at"], [other.encode() for other in step["others"]]) for step in path]


def _path_rows(paths: list[list[Step]]) -> pa.Array:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    return pa.array([[{"at": at, "others": [other.decode() for other in others]} for at, others in path] for path in paths], kind)


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(key, pos, path, subroot)`` of every node of a round: the steps in its block, then
    those ``above``, which the block's root has in the next round."""
    def down(rows: pa.Table) -> pa.RecordBatch:
        upper, own = _steps(rows.column("path")[0].as_py()), rows.slice(1)
        block, n = _block_of(own), own.num_rows
        return pa.RecordBatch.from_arrays(
            [own.column("key").combine_chunks(), own.column("pos").combine_chunks(), _path_rows([block.path(at) + upper for at in range(n)]),
             pa.array([rows.column("subroot")[0].as_py()] * n, pa.string())],
            ["key", "pos", "path", "subroot"])

    wide = _with_paths(nodes.select("key", "pos", "digest"), above)
    return keep(_by_blocks(wide, down, f"key string, pos long, path {PATH}, subroot string"), "paths")


@dataclass
class Manifest:
    """The nodes of a dataset's tree: ``rounds`` of each group, from its leaves to its
    root, and ``top``, from the groups' roots to the root of all."""

    rounds: list[DataFrame]
    top: list[DataFrame]

    @property
    def subroots(self) -> DataFrame:
        """``(key, subroot)``: ``=`` and the group's name, empty for rows without one."""
        return self.rounds[-1].selectExpr("key", "lower(hex(digest)) AS subroot")

    @property
    def root(self) -> DataFrame:
        return self.top[-1].selectExpr("lower(hex(digest)) AS root")

    def group_paths(self) -> DataFrame:
        """``(key, pos, path, subroot)`` of the groups' roots, each at position 0 of its own key."""
        paths = self.top[-1].selectExpr("key", "pos", f"CAST(array() AS {PATH}) AS path", "CAST(NULL AS STRING) AS subroot")
        for nodes in reversed(self.top[:-1]):
            paths = _paths(nodes, paths)
        named = self.top[0].selectExpr("own AS key", "pos AS place", "lower(hex(digest)) AS subroot")
        return keep(paths.withColumnRenamed("pos", "place").join(named, "place").select(
            named["key"], F.lit(0).cast("long").alias("pos"), "path", named["subroot"]), "paths")

    def versions(self) -> DataFrame:
        """One row per leaf: ``doc_id, leaf, subroot, root, proof_sha256`` of the dataset
        as it is, ``folded_root``, the root of the version that has the changed leaf
        instead, whether that is ``verified`` as the root, and ``n_copied``, the nodes
        that the version does not share."""
        paths = self.group_paths()
        for nodes in reversed(self.rounds[1:-1]):
            paths = _paths(nodes, paths)
        rows = self.rounds[0].select("key", "pos", "doc_id", "digest", "changed")
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_copied"]

        def fold(rows: pa.Table) -> pa.RecordBatch:
            upper, subroot, own = _steps(rows.column("path")[0].as_py()), rows.column("subroot")[0].as_py(), rows.slice(1)
            block, above = _block_of(own), [other for _, others in upper for other in others]
            root = copied(block.root, upper)[-1]
            proofs, folded, n_copied = [], [], []
            for at, changed in enumerate(own.column("changed").to_pylist()):
                path = block.path(at)
                version = copied(changed.hex().encode() if changed else block.levels[0][at], path)
                version += copied(version[-1], upper)[1:]
                proofs.append(hashed([other for _, others in path for other in others] + above).decode())
                folded.append(version[-1])
                n_copied.append(len(version) if changed else 0)
            n = own.num_rows
            return pa.RecordBatch.from_arrays(
                [own.column("doc_id").combine_chunks(), pa.array([leaf.decode() for leaf in block.levels[0]]), pa.array([subroot] * n, pa.string()),
                 pa.array([root.decode()] * n), pa.array(proofs), pa.array([f.decode() for f in folded]), pa.array([f == root for f in folded]),
                 pa.array(n_copied, pa.int64())], names)

        kind = rows.schema["doc_id"].dataType.simpleString()
        return _by_blocks(_with_paths(rows, paths), fold, (
            f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied long"))


def build(rows: DataFrame) -> Manifest:
    """The manifest of the rows of ``leaves``."""
    rounds = _rounds(in_order(rows, "doc_id", "digest"))
    groups = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("own"), "digest")
    return Manifest(rounds, _rounds(in_order(groups, "own")))
