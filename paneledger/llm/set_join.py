"""Exact Jaccard self-join of shingle sets, split by set size.

Small sets (at most ``boundary`` shingles) are joined by their subsets of a fixed
size: two sets of ``j`` and ``k`` elements link exactly if they share a subset of
``o(j, k)`` elements, the least overlap that reaches the similarity. Every set hands
out its subsets of that size for each size it may link to, so a shared subset is a
link already and nothing is verified; sets made of common passages only are no
trouble, as their subsets are as rare as themselves.

Large sets are joined by inverted lists over a prefix: with the elements of all sets
in one order, two linked sets share one of the first ``k - ceil(0.8 k) + 1`` elements
of each. Frequent elements come last in the order, so lists are short. A list is
scanned against one set of it first (a star, not all pairs), the one nearest to the
middle of its family; the sets so linked form components, and what still holds several
components is scanned around other sets once more. Only the lists left after that are
scanned for all pairs across components. Such a pair is verified if its sizes, its positions and the
number of prefix elements it shares allow the similarity; each of these tests is a
bound, so no link is lost. The boundary is the size at which handing out subsets
becomes dearer than handing out a prefix, over the sizes that the corpus has.

The class ids and elements are 64-bit hashes. Sets with equal ids are one class;
candidates are verified on their texts' shingles.

Cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text with fewer words than a shingle is one shingle; repeated rows are
one class, so repeated and null ids keep one row each (the smallest non-null id
names a component, null if there is none); other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneledger.llm.components import components
from paneledger.llm.hashing import mixed, shingle_sets
from paneledger.llm.keyed import marked, without
from paneledger.llm.text import batches_of, free_names, frequent, numbered
from paneledger.workspace import keep

SIMILARITY = (4, 5)
SHINGLE = 5
LARGEST_BOUNDARY = 16
# What a posting of a prefix costs against a subset: it is grouped, joined and verified.
POSTING_COST = 4
# Elements are ordered last if so many classes of a batch, and of the corpus, have them.
BATCH, COMMON_IN_BATCH, COMMON_IN_CORPUS, MOST_COMMON = 10_000, 8, 32, 100_000
# Texts compared with one hub in one task, and sets of one list compared with all others in one.
GROUP = 500
# Words of 64 parities in a sketch.
SKETCH = 16


def least_overlap(j: int, k: int) -> int:
    """Elements that sets of ``j`` and ``k`` must share: |a & b| / |a | b| >= 4 / 5."""
    num, den = SIMILARITY
    return -(-num * (j + k) // (num + den))


def prefix_length(k: int) -> int:
    num, den = SIMILARITY
    return k - -(-num * k // den) + 1


def partner_sizes(k: int, most: int) -> range:
    num, den = SIMILARITY
    return range(-(-num * k // den), min(most, den * k // num) + 1)


def boundary_of(sizes: dict[int, int]) -> int:
    """The largest size joined by subsets: total cost is least there."""
    def subsets(k: int, boundary: int) -> int:
        return sum(math.comb(k, least_overlap(j, k)) for j in partner_sizes(k, boundary))

    def cost(boundary: int) -> int:
        return sum(n * (subsets(k, boundary) if k <= boundary else prefix_length(k) * POSTING_COST) for k, n in sizes.items())

    return min(range(LARGEST_BOUNDARY + 1), key=lambda boundary: (cost(boundary), boundary))


def described(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size and class ``node``; the first row of a
    batch also lists the elements that many classes of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, own = [], [], {}
            for elements in shingle_sets(batch.column("text"), SHINGLE):
                sizes.append(len(elements))
                nodes.append(_node(elements) if len(elements) else None)
                if len(elements):
                    own[nodes[-1]] = elements
            common, times = _common(list(own.values()))
            lists = [[]] * batch.num_rows, [[]] * batch.num_rows
            if batch.num_rows:
                lists[0][0], lists[1][0] = common.view(np.int64).tolist(), times.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int64()))],
                ["row_key", "doc_id", "n_shingles", "node", "common", "times"])

    return numbered(docs, "doc_id", "text").mapInArrow(
        run, "row_key long, doc_id long, n_shingles long, node long, common array<long>, times array<long>")


def _node(elements: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(elements.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    elements = np.sort(np.concatenate(sets))
    starts = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]]))
    times = np.diff(np.append(starts, len(elements)))
    often = times >= COMMON_IN_BATCH
    return elements[starts[often]], times[often]


def handed_out(docs: DataFrame, boundary: int, common: np.ndarray) -> DataFrame:
    """What every document hands out: subsets (``element``, with the two sizes that
    link by it as ``pair``) if its set is small, prefix elements with their
    ``position`` (and no ``pair``) if it is large or may link to a large one."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(common))
    smallest_in_lists = -(-SIMILARITY[0] * (boundary + 1) // SIMILARITY[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            rows, held = [], 0
            for elements in shingle_sets(batch.column("text"), SHINGLE):
                k = len(elements)
                if not k:
                    continue
                node = _node(elements)
                if 1 < k <= boundary:
                    rows.append(_subsets(elements, node, boundary))
                    held += len(rows[-1][0])
                if k >= smallest_in_lists:
                    rows.append(_prefix(elements, node, late))
                    held += len(rows[-1][0])
                if held > 200_000:
                    yield _rows(rows)
                    rows, held = [], 0
            yield _rows(rows)

    return docs.select("text").mapInArrow(run, "element long, node long, size int, position int, pair int")


def _prefix(elements: np.ndarray, node: int, late: np.ndarray) -> tuple:
    k = len(elements)
    if len(late):
        found = late[np.minimum(np.searchsorted(late, elements), len(late) - 1)] == elements
        elements = np.concatenate([elements[~found], elements[found]])
    first = elements[:prefix_length(k)]
    n = len(first)
    return first, np.full(n, node), np.full(n, k), np.arange(n), np.zeros(n, np.int64)


def _subsets(elements: np.ndarray, node: int, boundary: int) -> tuple:
    size, own = len(elements), mixed(elements)
    found, pairs = [], []
    for partner in partner_sizes(size, boundary):
        overlap = least_overlap(size, partner)
        chosen = np.array(list(combinations(range(size), overlap)))
        found.append(mixed(own[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(overlap)))
        pairs.append(np.full(len(chosen), min(size, partner) * 256 + max(size, partner)))
    n = sum(map(len, found))
    return np.concatenate(found), np.full(n, node), np.full(n, size), np.zeros(n, np.int64), np.concatenate(pairs)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["element", "node", "size", "position", "pair"], [np.int64] * 2 + [np.int32] * 3
    columns = [np.concatenate(column) for column in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    columns[0] = columns[0].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kind, copy=False)) for c, kind in zip(columns, kinds)], names)


def listed(out: DataFrame) -> DataFrame:
    """What at least two classes hand out, copies put together: one shuffle by element."""
    once = out.repartition("element").dropDuplicates(["element", "pair", "node"])
    return _several(once, "node", ["element", "pair"])


def _several(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The rows of the groups that hold at least two values of ``column``."""
    group = Window.partitionBy(*by)
    ends = rows.withColumn("least", F.min(column).over(group)).withColumn("most", F.max(column).over(group))
    return ends.where("least <> most").drop("least", "most")


def subset_links(subsets: DataFrame) -> DataFrame:
    """Links of sets that share a subset: a star per subset and pair of sizes. Every
    set of one size links to every set of the other, so the star around the smallest
    of one size, and the one around the smallest of the other, lose nothing."""
    key, low, high = ["element", "pair"], "size = pair DIV 256", "size = pair % 256"
    ends = subsets.groupBy(*key).agg(
        F.min(F.expr(f"IF({low}, node, NULL)")).alias("low"), F.min(F.expr(f"IF({high}, node, NULL)")).alias("high")
    ).where("low IS NOT NULL AND high IS NOT NULL")
    return subsets.join(ends, key).selectExpr("node AS a", f"IF({low}, high, low) AS b").where("a <> b").distinct()


# Sizes a link allows, and the overlap still possible before and from the shared element on.
_ALLOWED = "5 * least(size, other_size) >= 4 * greatest(size, other_size) AND " \
    "9 * (least(position, other_position) + least(size - position, other_size - other_position)) >= 4 * (size + other_size)"


def with_share(lists: DataFrame) -> DataFrame:
    """``lists`` with the ``share`` of its prefix that each set has in lists: the sets
    in the middle of a family, which link to most of it, have the largest."""
    shares = lists.groupBy("node").agg(F.count("*").alias("listed"))
    return lists.join(shares, "node").withColumn("share", F.expr("listed / (size - ceil(4 * size / 5) + 1)")).drop("listed")


def star_pairs(lists: DataFrame, order: Column) -> DataFrame:
    """Every set with one hub of another group: of each list the set that is first in
    ``order``, of these hubs the one with which it has most lists, two at least. What a
    set does not link to there, a later turn or the scan across groups finds."""
    hubs = lists.groupBy("element").agg(F.min_by(F.struct("node", "size", "position", "own"), F.struct(order, "node")).alias("hub"))
    shared = (
        lists.join(hubs, "element").where("hub.node <> node AND hub.own <> own")
        .selectExpr("hub.node AS a", "node AS b", "size", "position", "hub.size AS other_size", "hub.position AS other_position")
        .where(_ALLOWED).groupBy("b", "a").count().where("count >= 2"))
    return shared.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")


def across(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that hold several groups, with the group of each set as ``own``."""
    grouped = lists.drop("own").join(groups.withColumnRenamed("component", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    return _several(grouped.repartition("element"), "own", ["element"]).select("element", "node", "size", "position", "own")


def sketches(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """``(node, s0, s1, ...)`` for the sets in ``lists``: the parity of the number of
    elements in each bucket. The sketches of two sets differ in no more places than
    the sets have elements that are not in both. Only their texts are read by Python."""
    wanted = keep(lists.select("node").distinct().join(classes, "node"), "wanted")
    texts = marked(numbered(docs, "text"), wanted, "row_key", "maybe").where("maybe").select("row_key", "text")
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.zeros((batch.num_rows, SKETCH), np.int64)
            for at, elements in enumerate(shingle_sets(batch.column("text"), SHINGLE)):
                buckets = (mixed(elements + np.uint64(SKETCH)) % np.uint64(64 * SKETCH)).astype(np.int64)
                odd = np.bincount(buckets, minlength=64 * SKETCH).astype(np.uint8) & 1
                words[at] = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), *[pa.array(words[:, k]) for k in range(SKETCH)]], ["row_key", *names])

    drawn = texts.mapInArrow(run, f"row_key long, {', '.join(f'{name} long' for name in names)}")
    return keep(drawn.join(wanted, "row_key").select("node", *names), "sketches")


def cross_pairs(lists: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pairs of different groups that share as many prefix elements as a link must:
    of its prefix a set can miss only what it may lack of the overlap, and the set
    whose prefix ends first in the order shares the rest within the other's prefix.

    Each set of a list is compared with all others in one of the list's parts, of about
    GROUP sets. Sizes, positions and sketches are tested where rows meet.
    """
    names = [f"s{k}" for k in range(SKETCH)]
    parts = lists.groupBy("element").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    rows = lists.join(parts, "element").join(drawn, "node")
    left = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).selectExpr(
        "element", "part", "node AS other", "size AS other_size", "position AS other_position", "own AS other_own", *[f"{name} AS other_{name}" for name in names])
    overlap = "ceil(4 * (size + other_size) / 9)"
    differ = " + ".join(f"bit_count({name} ^ other_{name})" for name in names)

    def needed(k: str) -> str:
        return f"({k} - ceil(4 * {k} / 5) + 1 - ({k} - {overlap}))"

    return (
        left.join(right, ["element", "part"]).where("node < other AND own <> other_own").where(_ALLOWED)
        .where(f"{differ} <= size + other_size - 2 * {overlap}")
        .groupBy("node", "other", "size", "other_size").count()
        .where(f"count >= least({needed('size')}, {needed('other_size')})")
        .selectExpr("node AS a", "other AS b"))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets reach the similarity. Only the texts in question
    are shuffled (a bit table of fixed size picks them during the scan): those of the
    ``b`` of one ``a``, in groups of at most about GROUP, behind a copy of ``a``."""
    pairs = keep(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = pairs.join(parts, "a").select(
        F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), F.lit(True).alias("member"))
    hubs = parts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                        F.col("a").alias("node"), F.lit(False).alias("member"))
    wanted = keep(members.unionByName(hubs).join(classes, "node"), "wanted")
    texts = marked(numbered(docs, "text"), wanted, "row_key", "maybe").where("maybe").join(wanted, "row_key")
    ordered = texts.select("hub", "part", "member", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements = None
        for batch in batches:
            hubs, nodes, linked = batch.column("hub").to_pylist(), batch.column("node").to_pylist(), []
            members = batch.column("member").to_pylist()
            for at, own in enumerate(shingle_sets(batch.column("text"), SHINGLE)):
                if not members[at]:
                    elements = own
                elif 9 * len(np.intersect1d(elements, own, assume_unique=True)) >= 4 * (len(elements) + len(own)):
                    linked.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hubs[at] for at in linked], pa.int64()), pa.array([nodes[at] for at in linked], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def similar_sets(docs: DataFrame) -> DataFrame:
    """``(row_key, doc_id, n_shingles, node, component)`` for every row of ``docs``;
    equal components are connected by links, a row alone has its own node."""
    batches_of(docs.sparkSession, BATCH)
    rows = keep(described(docs.select("doc_id", "text")), "sets")
    sizes = {row.n_shingles: row.n for row in rows.where(f"n_shingles BETWEEN 1 AND {LARGEST_BOUNDARY * 2}")
             .groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    boundary = boundary_of(sizes)
    often = rows.select(F.explode(F.arrays_zip("common", "times")).alias("x")).groupBy("x.common").agg(F.sum("x.times").alias("n"))
    top = frequent(often.where(f"n >= {COMMON_IN_CORPUS}"), MOST_COMMON).select("common").collect()
    common = np.array([row.common for row in top], np.int64).view(np.uint64)
    out = keep(listed(handed_out(docs, boundary, common)), "lists")
    lists = with_share(out.where("pair = 0").drop("pair").withColumn("own", F.col("node")))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("row_key").alias("row_key"))
    links = keep(subset_links(out.where("pair > 0")), "links")
    for order in (-F.col("share"), F.xxhash64("node")):
        links = links.unionByName(keep(verified(docs, classes, star_pairs(lists, order)), "links"))
        groups = components(links)
        lists = keep(across(lists, groups), "lists")
    more = keep(verified(docs, classes, cross_pairs(lists, sketches(docs, classes, lists))), "links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    found = rows.select("row_key", "doc_id", "n_shingles", "node").join(groups, "node", "left")
    return found.withColumn("component", F.coalesce("component", "node"))


def join_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id that links reach."""
    rows = similar_sets(docs)
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are linked, directly or not, to a row of smaller
    id (null ids last, then the first row); rows without words all stay."""
    rows = similar_sets(docs)
    [own] = free_names(docs.columns, "row_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min_by("row_key", order).alias("first"))
    gone = rows.join(first, "component").where("row_key <> first").select(F.col("row_key").alias(own))
    numbered_rows = docs.withColumn(own, F.monotonically_increasing_id())
    return without(numbered_rows, keep(gone, "copies"), own).select([F.col(f"`{c}`") for c in docs.columns])
