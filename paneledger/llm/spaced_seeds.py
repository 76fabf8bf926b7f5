"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask leaves visible in a window; what
the mask ignores may have been substituted. The three masks together hit every
window of WINDOW words in which at most WINDOW - ENOUGH were substituted (a test
goes through all of them). Seeds of the documents that may be among those of the
benchmark are joined to them by hash; a hit gives the shift between document and
item, and around it the two are compared word by word. A document is contaminated
by an item if some window of WINDOW words at one shift agrees in ENOUGH words; an
item of 8 to 12 words must be found whole and unchanged, and shorter ones, which
cannot be told from chance, are not searched for.

Documents are tested against a bit table of the benchmark's seeds that has one size
for any benchmark, so benchmark and documents may both be large; only what passes is
shuffled: the words around hits, and the hits.

Cases: null and empty texts and texts shorter than a window hit nothing, on either
side; null or repeated ids are kept apart by row and reported as they are; other
columns are not read by ``overlaps`` and carried by ``decontaminated``; an empty
table on either side gives no overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.llm.hashing import mixed, word_hashes
from paneledger.llm.keyed import without
from paneledger.llm.text import batches_of, free_names, numbered
from paneledger.workspace import keep

MASKS = ("111011", "1100001011", "110111")
WINDOW, ENOUGH, SHORTEST = 13, 10, 8
SPAN = max(map(len, MASKS))
# Three bits per seed in a table of 2 MiB.
BITS, PROBES = 1 << 24, 3
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def seeds(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask its number and the seed hash at every place where it fits."""
    for number, mask in enumerate(MASKS):
        n = max(0, len(words) - len(mask) + 1)
        total = np.full(n, number + 1, np.uint64)
        for k, at in enumerate(at for at, seen in enumerate(mask) if seen == "1"):
            total += mixed(words[at:at + n] * _SEEDS[k])
        yield number, mixed(total)


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(20 * k)) & np.uint64(BITS - 1)).astype(np.int64) for k in range(PROBES)]


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``(item_key, item_id, words)``, words as hashes, of the items long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for first, last, words, offsets in word_hashes(batch.column("text")):
                lists += [words[a:b].view(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], ["item_key", "item_id", "words"])

    rows = numbered(benchmark, "item_id", "text").mapInArrow(run, "item_key long, item_id long, words array<long>")
    return rows.where(F.size("words") >= SHORTEST)


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``(seed, item_key, place)`` of every mask at every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column("item_key").to_pylist(), batch.column("words")):
                for _, hashes in seeds(np.array(words.values, np.int64).view(np.uint64)):
                    yield pa.RecordBatch.from_arrays(
                        [_int64(hashes), pa.array(np.full(len(hashes), key)), _int64(np.arange(len(hashes)))], ["seed", "item_key", "place"])

    return items.mapInArrow(run, "seed long, item_key long, place long")


def _bit_table(seed_rows: DataFrame) -> np.ndarray:
    """One bit for each probe of each seed: at most BITS / 8 bytes reach the driver."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.asarray(batch.column("seed")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([_int64(np.concatenate(_bits(hashes)) + 1)], ["bit"])

    bits = seed_rows.select("seed").mapInArrow(probes, "bit long").groupBy((F.bitmap_bucket_number("bit") - 1).alias("bucket"))
    table = np.zeros(BITS // 8, np.uint8)
    for row in bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        table[row.bucket * 4096:(row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return table


def regions(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Stretches of documents around seeds that may be the benchmark's: ``(row_key,
    doc_id, start, words, hits)``, hits as (seed, place in the document)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    around = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for first, _, words, offsets in word_hashes(batch.column("text")):
                found, places = [], []
                ends = np.repeat(offsets[1:], np.diff(offsets))  # where the row of each word ends
                for number, hashes in seeds(words):
                    at = np.arange(len(hashes))
                    for probe in _bits(hashes):
                        probe = probe[at]
                        at = at[(bits[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1]
                    at = at[at + len(MASKS[number]) <= ends[at]]
                    found.append(hashes[at])
                    places.append(at)
                places, found = np.concatenate(places), np.concatenate(found)
                order = np.argsort(places, kind="stable")
                places, found = places[order], found[order]
                row = np.searchsorted(offsets, places, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (np.diff(places) > 2 * around) | (np.diff(row) > 0)])) if len(places) else []
                for a, b in zip(new, [*new[1:], len(places)]):
                    own = row[a]
                    start = max(offsets[own], places[a] - around)
                    end = min(offsets[own + 1], places[b - 1] + SPAN + around)
                    rows.append((keys[first + own], ids[first + own], int(start - offsets[own]), words[start:end].view(np.int64),
                                 found[a:b].view(np.int64), places[a:b] - offsets[own]))
            columns = list(zip(*rows)) if rows else [()] * 6
            ends = np.cumsum([0, *map(len, columns[4])])
            flat = [np.concatenate(column) if column else np.zeros(0, np.int64) for column in columns[4:]]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([_int64(x) for x in flat], ["seed", "at"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.list_(pa.int64())), hits], ["row_key", "doc_id", "start", "words", "hits"])

    return numbered(docs, "doc_id", "text").mapInArrow(
        run, "row_key long, doc_id long, start long, words array<long>, hits array<struct<seed: long, at: long>>")


def agreement(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Place, length and agreeing words of the stretch of ``words`` that repeats
    ``item`` (from its first to its last agreeing word), with ``words[p]`` beside ``item[p - shift]``; None if it is too little."""
    low, high = max(0, shift), min(len(words), shift + len(item))
    same = words[low:high] == item[low - shift:high - shift]
    if len(item) < WINDOW:
        return (low, len(item), len(item)) if len(same) == len(item) and same.all() else None
    if len(same) < WINDOW:
        return None
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= ENOUGH)
    if not len(good):
        return None
    agree = np.flatnonzero(same[good[0]:good[-1] + WINDOW]) + good[0]
    return low + int(agree[0]), int(agree[-1] - agree[0]) + 1, len(agree)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(row_key, doc_id, item_id, start, n_words, n_same)``: the longest overlap of
    each row of ``docs`` (doc_id, text) with each row of ``benchmark`` (item_id, text)."""
    batches_of(docs.sparkSession)
    items = keep(benchmark_words(benchmark), "items")
    seed_rows = keep(benchmark_seeds(items), "seeds")
    found = keep(regions(docs, _bit_table(seed_rows)), "regions")
    hits = found.select("row_key", "start", F.explode("hits").alias("hit")).select("row_key", "start", "hit.seed", "hit.at")
    shifts = hits.join(seed_rows, "seed").select("row_key", "start", "item_key", (F.col("at") - F.col("place") - F.col("start")).alias("shift")).distinct()
    both = (
        shifts.join(found.select("row_key", "doc_id", "start", "words"), ["row_key", "start"])
        .join(items.withColumnRenamed("words", "item"), "item_key"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, results = [], []
            for at, (words, item, shift) in enumerate(zip(batch.column("words"), batch.column("item"), batch.column("shift").to_pylist())):
                result = agreement(np.asarray(words.values), np.asarray(item.values), shift)
                if result:
                    kept.append(at)
                    results.append(result)
            out = batch.select(["row_key", "doc_id", "item_key", "item_id", "start"]).take(pa.array(kept, pa.int64()))
            place, length, same = np.array(results, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [*out.columns[:4], pa.array(np.asarray(out.column(4)) + place), pa.array(length), pa.array(same)],
                ["row_key", "doc_id", "item_key", "item_id", "start", "n_words", "n_same"])

    verified = both.select("row_key", "doc_id", "item_key", "item_id", "start", "words", "item", "shift").mapInArrow(
        verify, "row_key long, doc_id long, item_key long, item_id long, start long, n_words long, n_same long")
    longest = F.max(F.struct("n_words", "n_same", (-F.col("start")).alias("start"))).alias("x")
    return verified.groupBy("row_key", "doc_id", "item_key", "item_id").agg(longest).select(
        "row_key", "doc_id", "item_id", (-F.col("x.start")).alias("start"), "x.n_words", "x.n_same")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item of the benchmark overlaps, all columns."""
    [own] = free_names(docs.columns, "row_key")
    gone = keep(overlaps(docs, benchmark).select(F.col("row_key").alias(own)).distinct(), "overlaps")
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    return without(rows, gone, own).select([F.col(f"`{c}`") for c in docs.columns])
