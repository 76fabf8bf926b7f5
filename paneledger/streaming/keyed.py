"""Millions of small logs on Spark's own keyed state.

``streaming.fold`` plans every batch as a whole, which suits logs of any size. Where
logs are many and small, the state of a log is better kept with its key: Spark's state
store holds it, loads only the logs of the batch, and recovers it from the checkpoint. A
log's events of one batch are one group in one task, so this is for logs whose share of a
batch is small; a log that may hold a third of all events belongs to the fold.

Arrivals of a log must come in order from batch to batch; inside a batch they are sorted.
Watermarks are ``bounded`` or ``bounded-naive``, late events revise (``update``), and the
stream goes on (``idle``). Cases: rows without a log, a time or a place in the order are
left out; equal places follow their event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paneledger.config import Config
from paneledger.operators.arrival import index_log, reject_reason
from paneledger.streaming.fold import in_parts
from paneledger.workspace import new_path

PANES = (
    "log_id STRING, win_start BIGINT, win_end BIGINT, seq BIGINT, kind STRING, count BIGINT, retracts BIGINT, "
    "watermark BIGINT, at_index BIGINT, own_pane BOOLEAN, opened_index BIGINT"
)
# Position, highest event time, watermark, and of each live window its start, on-time and
# late events, the index that opened it, and whether it fired.
STATE = (
    "next_i BIGINT, max_seen BIGINT, w BIGINT, starts ARRAY<BIGINT>, on_time ARRAY<BIGINT>, late ARRAY<BIGINT>, "
    "opened ARRAY<BIGINT>, fired ARRAY<BOOLEAN>"
)


class _Log:
    """One log between batches; ``add`` takes one arrival and returns its panes."""

    def __init__(self, log_id: str, config: Config, state: tuple | None) -> None:
        self.log_id, self.config = log_id, config
        self.distance = config.watermark.bound_ms + (config.watermark.name == "bounded")
        self.next_i, self.max_seen, self.w, *windows = state or (0, None, None, [], [], [], [], [])
        self.windows = {start: list(rest) for start, *rest in zip(*windows)}

    def state(self) -> tuple:
        columns = [list(column) for column in zip(*self.windows.values())] or [[], [], [], []]
        return (self.next_i, self.max_seen, self.w, list(self.windows), *columns)

    def add(self, t: int) -> Iterator[tuple]:
        config, i, w = self.config, self.next_i, self.w
        start = t - (t - config.offset_ms) % config.window_ms
        end = start + config.window_ms
        if w is None or w < end + config.allowed_lateness_ms:
            window = self.windows.setdefault(start, [0, 0, i, False])
            if w is not None and w >= end:
                window[1] += 1
                on, late, opened, _ = window
                first = on == 0 and late == 1
                window[3] = True
                yield (self.log_id, start, end, late + (on > 0), "initial" if first else "revision", on + late,
                       None if first else on + late - 1, w, i, True, opened)
            else:
                window[0] += 1
        self.max_seen = t if self.max_seen is None else max(self.max_seen, t)
        after = self.max_seen - self.distance
        if w is None or after > w:
            yield from self._advance(after, i)
        self.next_i += 1

    def _advance(self, after: int, i: int) -> Iterator[tuple]:
        """Windows are kept in the order in which they were opened, and so close."""
        self.w = after
        for start, window in list(self.windows.items()):
            end = start + self.config.window_ms
            if end <= after and not window[3]:
                window[3] = True
                yield (self.log_id, start, end, 1, "initial", window[0], None, after, i, False, window[2])
            if end + self.config.allowed_lateness_ms <= after:
                del self.windows[start]


def panes_by_log(stream: DataFrame, order: list[str], config: Config) -> DataFrame:
    """The panes of every log of a stream of ``(log_id, t, *order)``, as they are emitted."""
    if config.watermark.name not in ("bounded", "bounded-naive") or (config.late_policy, config.termination) != ("update", "idle"):
        raise ValueError("keyed state serves bounded watermarks under update and idle; use streaming.fold")
    columns = PANES.replace(" STRING", "").replace(" BIGINT", "").replace(" BOOLEAN", "").split(", ")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = _Log(key[0], config, state.get if state.exists else None)
        arrivals = [row for part in batches for row in zip(*[part[c].tolist() for c in (*order, "t")])]
        panes = [pane for *_, t in sorted(arrivals) for pane in log.add(t)]
        state.update(log.state())
        if panes:
            # Objects, as a column of its own type for each would cost more than the log.
            yield pd.DataFrame(panes, columns=columns, dtype=object)

    valid = stream.select("log_id", "t", *order).where(f"({reject_reason(order)}) IS NULL")
    return valid.groupBy("log_id").applyInPandasWithState(run, PANES, STATE, "append", GroupStateTimeout.NoTimeout)


def replay_by_log(log: DataFrame, order: list[str], config: Config, batches: int) -> DataFrame:
    """The panes of a stored log, streamed in so many micro-batches; the query stops and
    starts again from its checkpoint after each."""
    spark = log.sparkSession
    source, target, checkpoint = (new_path(spark, name) for name in ("replay", "keyed", "checkpoint"))
    parts = in_parts(index_log(log, order).rows.select(*dict.fromkeys(["log_id", "t", *order, "i"])), batches)
    for n in range(batches):
        part = parts.where(f"part_n = {n}").drop("part_n")
        part.write.mode("append").parquet(source)
        panes = panes_by_log(spark.readStream.schema(part.schema).parquet(source), order, config)
        panes.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(PANES).parquet(target)
