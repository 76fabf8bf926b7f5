"""The five watermark strategies, and those of the user's own.

Each takes an arrival index and adds ``raw`` (what the strategy says after the
event), ``w_after`` (the emitted watermark after the event: the running maximum
of ``raw``, so it never falls) and ``w_before`` (the emitted watermark that the
event is judged against; NULL while it has never advanced).

In a streaming run the rows also carry the state of their log, the scalar columns
``s_*`` of ``streaming.fold``. Without them, a log starts empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from paneledger.config import CustomWatermark, WatermarkSpec
from paneledger.operators.arrival import EVENT_LATENESS
from paneledger.operators.judge import aggregates
from paneledger.operators.scan import (
    block_carry, frames, last_known, ordered_scan, running_max, running_max_before, with_carry,
)
from paneledger.workspace import remember

MIN_BLOCK_ROWS = 8_192


def block_rows(rows: DataFrame, total: int, multiple_of: int) -> int:
    """Rows per block: as many blocks as shuffle partitions for a large log, and
    never less than MIN_BLOCK_ROWS. Blocks start at multiples of ``multiple_of``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(MIN_BLOCK_ROWS, -(-total // partitions))
    return -(-wanted // multiple_of) * multiple_of


def start_of(position: str, size: int) -> str:
    """First position of the fixed-size block that holds ``position``."""
    return f"({position}) - ({position}) % {size}L"


def block_of(position: str, first: str, size: int) -> str:
    """The same, with blocks counted from the position ``first``."""
    return f"{first} + {start_of(f'{position} - ({first})', size)}"


def from_maximum(rows: DataFrame, shift: int) -> DataFrame:
    """Watermark = highest event time seen - shift."""
    after = f"max_seen - {shift}L"
    return rows.selectExpr("*", f"{after} AS raw", f"{after} AS w_after", f"max_before - {shift}L AS w_before")


def from_arrivals(rows: DataFrame, spec: WatermarkSpec) -> DataFrame:
    """Watermark = origin + arrivals so far * rate. Reads no event time after the
    first one; wrong on purpose, kept as a detection target."""
    origin = "first_t" if spec.origin_ms is None else f"({spec.origin_ms}L)"
    after = f"{origin} + i * {spec.ms_per_event}L"
    before = f"CASE WHEN i > 0 THEN {origin} + (i - 1) * {spec.ms_per_event}L END"
    return rows.selectExpr("*", f"{after} AS raw", f"{after} AS w_after", f"{before} AS w_before")


def from_punctuation(rows: DataFrame, spec: WatermarkSpec, total: int, size: int | None) -> DataFrame:
    """Watermark = lowest event time of the last complete group of N arrivals - 1.

    Blocks are aligned to groups, so a group lies in one block.
    """
    n = spec.every_n
    size = -(-size // n) * n if size else block_rows(rows, total, n)
    # A group begun in an earlier micro-batch already has a lowest event time. Blocks
    # are counted from the batch's first group, so only logs with many events in the
    # batch are cut, however far all of them have come.
    streaming = "s_next_i" in rows.columns
    first = start_of("coalesce(s_next_i, 0L)", n) if streaming else "0L"
    rows = rows.drop("blk").selectExpr("*", f"{start_of('i', n)} AS grp", f"{block_of('i', first, size)} AS blk")
    low = f"least(t, CASE WHEN grp = {start_of('s_next_i', n)} THEN s_open_min END)" if streaming else "t"
    rows = rows.selectExpr("*", f"{low} AS low")
    marks = {"w_after": running_max("w_after", "mark"), "raw": last_known("raw", "mark")}

    groups = rows.groupBy("log_id", "blk", "grp").agg(*aggregates(low="min(low)", last_i="max(i)"))
    # A block whose last group is incomplete passes on less, but needs the carry.
    complete = f"FILTER (WHERE last_i % {n} = {n - 1})"
    blocks = groups.groupBy("log_id", "blk").agg(*aggregates(
        block_w_after=f"max(low - 1) {complete}", block_raw=f"max_by(low - 1, grp) {complete}"))
    carry = remember(block_carry(blocks, ["log_id"], marks).selectExpr("*", "carry_w_after AS carry_w_before"))

    group, block = frames(["log_id", "blk", "grp"], ["i"]), frames(["log_id", "blk"], ["i"])
    marks["w_before"] = running_max_before("w_after", "mark")
    local = (
        rows.selectExpr("*", f"CASE WHEN i % {n} = {n - 1} THEN min(low) {group['up_to']} - 1 END AS mark")
        .selectExpr("*", *[f"{m.local.format(**block)} AS {name}" for name, m in marks.items()])
        .drop("grp", "low", "mark")
    )
    local = remember(local)
    return with_state(with_carry(local, carry, ["log_id"], marks))


def from_quantile(rows: DataFrame, spec: WatermarkSpec, total: int, size: int | None, samples: DataFrame | None) -> DataFrame:
    """Watermark = highest event time - quantile of the last S lateness values - 1.

    Spark has no sliding exact quantile that updates as the frame moves, so each
    block is streamed once through numpy. A block starts with a copy of the S rows
    before it and needs nothing else from other blocks.
    """
    sample = spec.sample_size
    size = max(size, sample) if size else max(block_rows(rows, total, 1), 16 * sample)
    rows = rows.drop("blk")
    schema = StructType([*rows.schema, *[StructField(name, LongType()) for name in ("blk", "raw", "w_after", "w_before")]])
    # Blocks are counted from the first event of a micro-batch, as in from_punctuation.
    block = block_of("i", "coalesce(s_next_i, 0L)" if "s_next_i" in rows.columns else "0L", size)
    spread = rows.selectExpr(
        "*", f"CASE WHEN max_before IS NOT NULL THEN {EVENT_LATENESS} END AS lat", block_copies(block, "i", size, sample),
    ).selectExpr("*", f"blk = {block} AS own")
    if samples is not None:
        kept = samples.selectExpr("log_id", "next_i", "size(lats) AS kept", "posexplode(lats) AS (pos, lat)")
        kept = kept.selectExpr("log_id", "next_i", "lat", "next_i - kept + pos AS i")
        kept = kept.selectExpr("log_id", "i", "lat", "next_i AS blk", "false AS own")
        spread = spread.unionByName(kept, allowMissingColumns=True)
    streamed = (
        spread.repartition("log_id", "blk").sortWithinPartitions("log_id", "blk", "i")
        .mapInArrow(sliding_quantile(spec, schema.names), schema)
    )
    local = remember(streamed)
    running = {"w_after": running_max("w_after", "raw"), "w_before": running_max_before("w_after", "raw")}
    highest = local.groupBy("log_id", "blk").agg(*aggregates(block_w_after="max(raw)", block_w_before="max(raw)"))
    carry = remember(block_carry(highest, ["log_id"], running))
    return with_state(with_carry(local, carry, ["log_id"], running))


def from_function(rows: DataFrame, spec: CustomWatermark) -> DataFrame:
    """A strategy of the user's own: any set-based rule for ``raw``."""
    running = {"w_after": running_max("w_after", "raw"), "w_before": running_max_before("w_after", "raw")}
    return with_state(ordered_scan(spec.raw(rows.drop("blk")), ["log_id"], ["i"], running, derived=True).rows)


def block_copies(block: str, position: str, size: int, sample: int) -> str:
    """Explode a row into its block, and into the next one if it is among the last
    ``sample`` rows before it."""
    near_end = f"{position} >= {block} + {size - sample}L"
    return f"explode(CASE WHEN {near_end} THEN array({block}, {block} + {size}L) ELSE array({block}) END) AS blk"


def sliding_ranks(values: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size`` values the one at its rank, from 0.

    Windows go in groups of about the square root of ``size``. What all windows of a
    group share is sorted once; a window differs from it by fewer values than the group
    has windows, so its answer is among these and a short stretch of the sorted ones.
    """
    n = len(values) - size + 1
    group = min(size, max(2, 2 * int(size ** 0.5)))
    found = np.empty(n, values.dtype)
    for first in range(0, n, group):
        last = min(first + group, n)
        shared = np.sort(values[last - 1:first + size])
        others = np.concatenate([values[first:last - 1], values[first + size:last - 1 + size]])
        own = ranks[first:last]
        low = max(0, int(own.min()) - (last - first - 1))
        near = shared[low:int(own.max()) + 1]
        rows = np.empty((last - first, last - first - 1 + len(near)), values.dtype)
        rows[:, last - first - 1:] = near
        if last - first > 1:
            rows[:, :last - first - 1] = np.lib.stride_tricks.sliding_window_view(others, last - first - 1)
        if own[0] == own[-1]:
            rows.partition(own[0] - low, axis=1)
        else:
            rows.sort(axis=1)
        found[first:last] = rows[np.arange(last - first), own - low]
    return found


class SlidingBound:
    """The watermark's distance from the highest event time, along one block of a log:
    the quantile of the last S lateness values, ``floor_ms`` at least."""

    _NONE = np.iinfo(np.int64).max

    def __init__(self, spec: WatermarkSpec) -> None:
        self.spec, self.recent, self.held = spec, np.zeros(0, np.int64), None

    def bounds(self, late: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each row the bound after it; ``known`` says which rows have a lateness."""
        size, values = self.spec.sample_size, np.concatenate([self.recent, late[known]])
        out = np.zeros(len(late), np.int64)
        if len(values):
            # Places before the first value count as very large, so that all windows are full.
            filled = np.arange(1 + len(self.recent), len(values) + 1)
            held = np.minimum(np.concatenate([[len(self.recent)], filled]), size)
            ranks = np.minimum(np.maximum(held - 1, 0), (self.spec.percentile * held).astype(np.int64))
            padded = np.concatenate([np.full(max(0, size - len(self.recent)), self._NONE), values])
            at = sliding_ranks(padded, ranks, size)
            at[held == 0] = 0
            out = at[np.cumsum(known)]
        self.recent = values[-size:]
        return np.maximum(out, self.spec.floor_ms)

    def marks(self, late: np.ndarray, known: np.ndarray, own: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw watermarks of the ``own`` rows, their running maximum, and the maximum
        before each, masked where there is none."""
        raws = (seen - self.bounds(late, known) - 1)[own]
        if not len(raws):
            return raws, raws, np.ma.array(raws)
        afters = np.maximum.accumulate(raws if self.held is None else np.maximum(raws, self.held))
        first = self.held is None
        befores = np.concatenate([[0 if first else self.held], afters[:-1]])
        self.held = int(afters[-1])
        none = np.zeros(len(raws), bool)
        none[0] = first
        return raws, afters, np.ma.array(befores, mask=none)


def sliding_quantile(spec: WatermarkSpec, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream rows sorted by (log_id, blk, i); memory is a batch and one sample of S values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bound = None, SlidingBound(spec)
        for batch in batches:
            if not batch.num_rows:
                continue
            late = batch.column("lat")
            known = late.is_valid().to_numpy(zero_copy_only=False)
            late, seen = late.fill_null(0).to_numpy(), batch.column("max_seen").fill_null(0).to_numpy()
            own = batch.column("own").to_numpy(zero_copy_only=False)
            parts = []
            for start, end in _stretches(batch, ["log_id", "blk"]):
                name = (batch.column("log_id")[start].as_py(), batch.column("blk")[start].as_py())
                if name != block:
                    block, bound = name, SlidingBound(spec)
                parts.append(bound.marks(late[start:end], known[start:end], own[start:end], seen[start:end]))
            mine = batch.filter(batch.column("own"))
            if mine.num_rows:
                raws, afters = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
                befores = np.ma.concatenate([part[2] for part in parts if len(part[0])])
                arrays = [mine.column(name) for name in columns[:-3]]
                arrays += [pa.array(raws), pa.array(afters), pa.array(befores.data, mask=np.ma.getmaskarray(befores))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def _stretches(batch: pa.RecordBatch, by: list[str]) -> list[tuple[int, int]]:
    """Where rows with equal ``by`` begin and end."""
    if batch.num_rows == 1:
        return [(0, 1)]
    new = np.zeros(batch.num_rows - 1, bool)
    for name in by:
        column = batch.column(name)
        new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, batch.num_rows]))


def with_state(rows: DataFrame) -> DataFrame:
    """A streaming run starts from the watermark it had emitted."""
    if "s_w" not in rows.columns:
        return rows
    return rows.selectExpr(
        *[c for c in rows.columns if c not in ("raw", "w_after", "w_before")],
        "coalesce(raw, s_raw) AS raw", "greatest(w_after, s_w) AS w_after", "greatest(w_before, s_w) AS w_before",
    )


def attach_watermark(
    rows: DataFrame, spec: WatermarkSpec | CustomWatermark, total: int, block_size: int | None = None, samples: DataFrame | None = None,
) -> DataFrame:
    """Indexed rows, ``total`` in number, with ``raw``, ``w_before`` and ``w_after``.
    ``block_size`` sets the rows per block of the punctuated and percentile strategies,
    which follows from ``total`` otherwise; ``samples``
    are the lateness values ``(log_id, next_i, lats)`` a streaming run kept."""
    if isinstance(spec, CustomWatermark):
        return from_function(rows, spec)
    if spec.name == "percentile":
        return from_quantile(rows, spec, total, block_size, samples)
    if spec.name == "punctuated":
        return from_punctuation(rows, spec, total, block_size)
    if spec.name == "processing-time":
        return from_arrivals(rows, spec)
    return from_maximum(rows, spec.bound_ms + (1 if spec.name == "bounded" else 0))
