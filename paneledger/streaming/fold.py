"""Exact streaming: a fold over micro-batches with carried state.

The engine's watermark moves at every event, while Spark's native watermark moves
once per micro-batch and drops late rows without a receipt. So each micro-batch is
run through the batch operators, starting from the state that the one before left:

- ``logs``     per log: position, highest event time, watermark, and what the
  strategy needs (lowest event time of the open group; the last S lateness values)
- ``windows``  per live window: counts, first index, whether it fired. A window
  leaves once the watermark passes its end plus the allowed lateness, so the
  state holds only what can still change.

State and outputs of batch N lie in ``.../batch_id=N``. The state is a log of changes:
a batch reads what concerns its own logs, the latest row of each from the last whole
state and the changes since, and writes only the logs and windows that it changed, so
what it writes follows the batch and not the number of logs. Every ``whole_every``-th
batch writes a whole state instead. A batch that is retried reads the state of N-1 and
overwrites its own folders, so the tables are exact under restarts; states that no
retry needs are deleted, and readers see ended batches only. Rows
without a log, a time or a place in the order go to the quarantine table, and so do
rows behind the last position of their log. What a batch keeps in memory is freed
when it ends, also by an error. However a log is cut into batches, the tables are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paneledger.config import Config
from paneledger.names import END_OF_STREAM
from paneledger.operators import audit, judge, panes
from paneledger.operators.arrival import EVENT_LATENESS, index_log, reject_reason
from paneledger.operators.crossing import FIRE, crossings
from paneledger.operators.truth import batch_windows
from paneledger.operators.watermarks import attach_watermark, start_of
from paneledger.workspace import delete, new_path, remember, scope

LOG_STATE = (
    "log_id STRING, next_i BIGINT, max_seen BIGINT, first_t BIGINT, w BIGINT, raw BIGINT, "
    "open_min BIGINT, lats ARRAY<BIGINT>, last_key STRING"
)
WINDOW_STATE = (
    "log_id STRING, win_start BIGINT, win_end BIGINT, on_time BIGINT, late_in_bound BIGINT, first_index BIGINT, fired BOOLEAN"
)
OUTPUTS = {
    "panes": "log_id STRING, win_start BIGINT, win_end BIGINT, seq BIGINT, kind STRING, count BIGINT, retracts BIGINT, "
             "watermark BIGINT, at_index BIGINT, own_pane BOOLEAN, opened_index BIGINT",
    "side_output": "log_id STRING, index BIGINT, t BIGINT, win_start BIGINT, win_end BIGINT, reason STRING, lateness_ms BIGINT",
    "trace": "log_id STRING, index BIGINT, watermark BIGINT",
    "released": WINDOW_STATE,
}
KEYS = ["log_id", "win_start"]
# What the state's rows have besides: the batch that wrote them, and whether the window has left.
LOGGED = ", at BIGINT, gone BOOLEAN"
STATES = {"logs": (LOG_STATE, ["log_id"]), "windows": (WINDOW_STATE, KEYS)}
# A batch of no more logs than this sends their state to the rows, without a shuffle of these.
FEW_LOGS = 10_000
SCALARS = ["next_i", "max_seen", "first_t", "w", "raw", "open_min"]


def with_log_state(rows: DataFrame, logs: DataFrame, few: bool = False) -> DataFrame:
    """Continue positions and maxima where the state left them, and add the ``s_*`` columns."""
    state = logs.selectExpr("log_id", *[f"{c} AS s_{c}" for c in SCALARS])
    joined = panes.per_log(rows, state, few)
    shifted = {
        "i": "i + coalesce(s_next_i, 0L)", "max_seen": "greatest(max_seen, s_max_seen)",
        "max_before": "greatest(max_before, s_max_seen)", "first_t": "coalesce(s_first_t, first_t)",
    }
    others = [c for c in joined.columns if c not in [*shifted, "s_max_seen", "s_first_t"]]
    return joined.selectExpr(*others, *[f"{sql} AS {name}" for name, sql in shifted.items()])


def next_logs(logs: DataFrame, judged: DataFrame, order: list[str], config: Config, few: bool = False) -> DataFrame:
    """The per-log state after a batch."""
    spec = config.watermark
    seen = judged.groupBy("log_id").agg(*judge.aggregates(
        b_next="max(i) + 1", b_max="max(max_seen)", b_first="min_by(first_t, i)", b_w="max(w_after)", b_raw="max_by(raw, i)",
        b_last=f"max_by(struct({', '.join(order)}), i)"))
    seen = seen.selectExpr("*", f"{_key([f'b_last.{c}' for c in order])} AS b_key").drop("b_last")
    if spec.name == "punctuated":
        # The group that is open after the batch; an earlier batch may have begun it.
        n = spec.every_n
        groups = judged.selectExpr("log_id", f"{start_of('i', n)} AS grp", "t", "s_next_i", "s_open_min").groupBy("log_id", "grp").agg(
            *judge.aggregates(low="min(t)", rows_to="count(1)", s_next_i="max(s_next_i)", s_open_min="max(s_open_min)"))
        opened = groups.selectExpr(
            "log_id", "grp", f"CASE WHEN grp = {start_of('s_next_i', n)} THEN least(low, s_open_min) ELSE low END AS low")
        opened = seen.selectExpr("log_id", f"{start_of('b_next', n)} AS grp").join(opened, ["log_id", "grp"])
        seen = seen.join(opened.selectExpr("log_id", "low AS b_open"), "log_id", "left")
    else:
        seen = seen.selectExpr("*", "CAST(NULL AS BIGINT) AS b_open")
    if spec.name == "percentile":
        size = spec.sample_size
        tail = panes.per_log(judged, seen.select("log_id", "b_next"), few).where(
            f"i >= b_next - {size} AND max_before IS NOT NULL")
        tail = tail.selectExpr("log_id", f"struct(i, {EVENT_LATENESS} AS lat) AS x").groupBy("log_id").agg(
            *judge.aggregates(b_lats="transform(array_sort(collect_list(x)), v -> v.lat)"))
        seen = seen.join(tail, "log_id", "left")
        lats = f"slice(concat(array_repeat(-1L, {size}), coalesce(lats, array()), coalesce(b_lats, array())), -{size}, {size})"
        lats = f"filter({lats}, v -> v >= 0)"
    else:
        seen, lats = seen.selectExpr("*", "CAST(NULL AS ARRAY<BIGINT>) AS b_lats"), "CAST(NULL AS ARRAY<BIGINT>)"
    open_min = "CASE WHEN b_next IS NULL THEN open_min ELSE b_open END"
    return logs.join(seen, "log_id", "full_outer").selectExpr(
        "log_id", "coalesce(b_next, next_i) AS next_i", "coalesce(b_max, max_seen) AS max_seen",
        "coalesce(first_t, b_first) AS first_t", "greatest(b_w, w) AS w", "coalesce(b_raw, raw) AS raw",
        f"{open_min} AS open_min", f"{lats} AS lats", "coalesce(b_key, last_key) AS last_key")


def _key(order: list[str]) -> str:
    """Order columns of a row as text that sorts like them (whole numbers of up to 38 digits)."""
    number = "CAST({c} AS DECIMAL(38, 0))"
    digits = "lpad(CAST({v} AS STRING), 38, '0')"
    below, above = digits.replace("{v}", f"{'9' * 38}BD + {number}"), digits.replace("{v}", number)
    part = f"CASE WHEN {{c}} IS NULL THEN '' WHEN {{c}} < 0 THEN concat('-', {below}) ELSE concat('0', {above}) END"
    return f"concat_ws('/', {', '.join(part.format(c=c) for c in order)})"


def _last_place(order: list[str]) -> list[str]:
    """The numbers in ``last_key``, a text of ``_key``: a column ``last_<name>`` for each of ``order``."""
    number = "CAST(nullif(substring({v}, 2), '') AS DECIMAL(38, 0))"
    parts = [f"split(last_key, '/')[{n}]" for n in range(len(order))]
    return [f"IF(startswith({v}, '-'), {number.format(v=v)} - {'9' * 38}BD, {number.format(v=v)}) AS last_{c}" for c, v in zip(order, parts)]


def _behind(rows: DataFrame, order: list[str]) -> str:
    """SQL of whether a row's place is at or before ``last_*``."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    behind = None
    for c in reversed(order):
        kind = "BIGINT" if dict(rows.dtypes)[c] in whole else "DECIMAL(38, 0)"
        here, last = f"CAST({c} AS {kind})", f"CAST(last_{c} AS {kind})"
        behind = f"{here} <= {last}" if behind is None else f"({here} < {last} OR {here} = {last} AND ({behind}))"
    return behind


def judge_batch(logs: DataFrame, batch: DataFrame, order: list[str], config: Config, few: bool = False) -> DataFrame:
    """The batch, judged as a continuation of its logs."""
    index = index_log(batch, order)
    rows = with_log_state(index.rows, logs, few)
    samples = None
    if config.watermark.name == "percentile":
        samples = logs.where("size(lats) > 0").select("log_id", "next_i", "lats").join(
            batch.select("log_id").distinct(), "log_id", "left_semi")
    return judge.judge(attach_watermark(rows, config.watermark, index.total, None, samples), config)


def merge_windows(live: DataFrame, judged: DataFrame) -> DataFrame:
    """Live windows with the counts of the batch added."""
    now = judge.tally(judged).where(panes.HAS_STATE).selectExpr(
        *KEYS, "win_end AS b_end", "on_time AS b_on", "late_in_bound AS b_late", "first_index AS b_first",
        "first_late_index", "first_late_after")
    return live.join(now, KEYS, "full_outer").selectExpr(
        *KEYS, "coalesce(win_end, b_end) AS win_end",
        "coalesce(on_time, 0L) + coalesce(b_on, 0L) AS on_time",
        "coalesce(late_in_bound, 0L) + coalesce(b_late, 0L) AS late_in_bound",
        "coalesce(first_index, b_first) AS first_index", "coalesce(fired, false) AS fired",
        "first_late_index", "first_late_after", "b_on IS NOT NULL AS counted")


def batch_panes(live: DataFrame, merged: DataFrame, judged: DataFrame, config: Config) -> DataFrame:
    """The panes that the batch caused: closes of waiting windows, and late events."""
    waiting = merged.where("NOT fired")
    closed = waiting.join(crossings(judged, waiting.where("on_time > 0"), config, [FIRE]), KEYS, "left")
    update = config.late_policy == "update"
    closed = closed.where("on_time > 0 AND fire IS NOT NULL" if update else "fire IS NOT NULL OR on_time = 0")
    out = closed.selectExpr(
        *KEYS, "win_end", "1L AS seq", "'initial' AS kind", "on_time AS count", "CAST(NULL AS BIGINT) AS retracts",
        "coalesce(fire.watermark, first_late_after) AS watermark", "coalesce(fire.index, first_late_index) AS at_index",
        "false AS own_pane", "first_index AS opened_index")
    return out.unionByName(panes.late_panes(judged, merged, live).select(*panes.PANE_COLUMNS)) if update else out


def next_windows(merged: DataFrame, new_panes: DataFrame, logs: DataFrame, config: Config, few: bool = False) -> DataFrame:
    """The windows after the batch; ``done`` marks those the watermark released, ``changed``
    those that are not as they were, for another reason."""
    fired_now = new_panes.where("NOT own_pane").selectExpr(*KEYS, "true AS fired_now")
    windows = merged.join(fired_now, KEYS, "left").selectExpr(
        *KEYS, "win_end", "on_time", "late_in_bound", "first_index",
        "fired OR coalesce(fired_now, false) OR on_time = 0 AS fired", "counted OR coalesce(fired_now, false) AS changed")
    return panes.per_log(windows, logs.select("log_id", "w"), few).selectExpr(
        "*", f"coalesce(w >= win_end + {config.allowed_lateness_ms}L, false) AS done").drop("w")


@dataclass(frozen=True)
class FoldTables:
    """The folders of a fold, and its tables."""

    spark: SparkSession
    path: str
    config: Config
    order: tuple[str, ...]
    whole_every: int = 16

    def folder(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/batch_id={batch_id}"

    def _whole(self, batch_id: int) -> int:
        """The last batch up to this one that wrote a whole state."""
        return batch_id - batch_id % self.whole_every

    def state(self, table: str, batch_id: int, logs: DataFrame | None = None) -> DataFrame:
        """The state after a batch, of all logs or of some: the latest row of each key."""
        schema, keys = STATES[table]
        if batch_id < 0:
            # Nothing that the engine would have to run to see that it is empty.
            return self.spark.sql(f"SELECT {', '.join('CAST(NULL AS {1}) AS {0}'.format(*c.split()) for c in schema.split(', '))} WHERE false")
        folders = [self.folder(f"state_{table}", n) for n in range(self._whole(batch_id), batch_id + 1)]
        rows = self.spark.read.schema(schema + LOGGED).parquet(*folders)
        if logs is not None:
            rows = rows.join(logs, "log_id", "left_semi")
        if len(folders) > 1:
            values = [c for c in rows.columns if c not in keys]
            rows = rows.groupBy(*keys).agg(*judge.aggregates(x=f"max_by(struct({', '.join(values)}), at)")).selectExpr(*keys, "x.*")
        return rows.where("NOT gone").drop("at", "gone")

    def _log_state(self, table: str, batch_id: int, changed: DataFrame, logs: DataFrame) -> None:
        """Write what a batch changed, or the whole state if it is its turn: ``changed``
        and the rows of all other logs."""
        if batch_id and self._whole(batch_id) == batch_id:
            others = self.state(table, batch_id - 1).join(logs, "log_id", "left_anti").selectExpr("*", "false AS gone")
            changed = changed.where("NOT gone").unionByName(others)
        self._write(changed.selectExpr("*", f"{batch_id}L AS at"), f"state_{table}", batch_id)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function."""
        with scope():
            self._fold(batch, batch_id)
        # A retry of this batch needs the state of the one before it.
        last = self._whole(batch_id - 1) if batch_id else 0
        for table in ("state_logs", "state_windows"):
            for n in range(max(0, last - self.whole_every), last):
                delete(self.spark, self.folder(table, n))

    def _fold(self, batch: DataFrame, batch_id: int) -> None:
        config, order = self.config, list(self.order)
        here = remember(batch.where("log_id IS NOT NULL").select("log_id").distinct())
        few = here.count() <= FEW_LOGS
        logs = remember(self.state("logs", batch_id - 1, here))
        live = remember(self.state("windows", batch_id - 1, here))
        # A row at or before the last one of its log came too late to have a position.
        placed = panes.per_log(batch, logs.selectExpr("log_id", *_last_place(order)), few)
        stray = f"({reject_reason(order)}) IS NOT NULL OR coalesce({_behind(batch, order)}, false)"
        placed = remember(placed.selectExpr(*batch.columns, f"{stray} AS stray"))
        self._write(placed.where("stray").drop("stray"), "quarantine", batch_id)

        judged = judge_batch(logs, placed.where("NOT stray").drop("stray"), order, config, few)
        judged = remember(judged)
        merged = remember(merge_windows(live, judged))
        after = remember(next_logs(logs, judged, order, config, few))
        self._log_state("logs", batch_id, after.selectExpr("*", "false AS gone"), here)
        new_panes = self._write(batch_panes(live, merged, judged, config), "panes", batch_id)
        self._write(judge.receipts(judged, config), "side_output", batch_id)
        self._write(judge.trace(judged), "trace", batch_id)
        windows = remember(next_windows(merged, new_panes, after, config, few))
        self._write(windows.where("done").drop("done", "changed"), "released", batch_id)
        whole = batch_id and self._whole(batch_id) == batch_id
        kept = windows if whole else windows.where("changed OR done")
        self._log_state("windows", batch_id, kept.withColumnRenamed("done", "gone").drop("changed"), here)

    def _write(self, table: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Write one table of a batch, replacing what a failed attempt left."""
        path = self.folder(name, batch_id)
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def read(self, name: str, last: int) -> DataFrame:
        """An output up to batch ``last``, the last one that has ended."""
        return self.spark.read.schema(OUTPUTS[name] + ", batch_id BIGINT").parquet(f"{self.path}/{name}").where(f"batch_id <= {last}").select(
            *[part.split()[0] for part in OUTPUTS[name].split(", ")])

    def start(self, stream: DataFrame, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


@dataclass(frozen=True)
class FoldResult:
    """The tables of a fold after batch ``last`` (of a live stream, the last committed one)."""

    tables: FoldTables
    last: int

    @property
    def logs(self) -> DataFrame:
        return self.tables.state("logs", self.last)

    @property
    def live(self) -> DataFrame:
        return self.tables.state("windows", self.last)

    @property
    def flushed(self) -> bool:
        return self.tables.config.termination == "flush"

    @property
    def panes(self) -> DataFrame:
        """Every pane; a flush closes the windows that still wait."""
        out = self.tables.read("panes", self.last)
        if self.flushed:
            waiting = panes.per_log(self.live.where("NOT fired AND on_time > 0"), self.logs.select("log_id", "next_i"))
            out = out.unionByName(waiting.selectExpr(
                "log_id", "win_start", "win_end", "1L AS seq", "'initial' AS kind", "on_time AS count",
                "CAST(NULL AS BIGINT) AS retracts", f"{END_OF_STREAM}L AS watermark", "next_i AS at_index",
                "false AS own_pane", "first_index AS opened_index"))
        return out

    @property
    def side_output(self) -> DataFrame:
        return self.tables.read("side_output", self.last)

    @property
    def trace(self) -> DataFrame:
        out = self.tables.read("trace", self.last)
        if self.flushed:
            out = out.unionByName(self.logs.selectExpr("log_id", "next_i AS index", f"{END_OF_STREAM}L AS watermark"))
        return out

    @property
    def windows(self) -> DataFrame:
        """Released and live windows, as the audit takes them."""
        late = "late_in_bound" if self.tables.config.late_policy == "update" else "0L"
        every = self.tables.read("released", self.last).unionByName(self.live)
        return every.selectExpr(
            "*", f"fired OR {str(self.flushed).lower()} AS closed").selectExpr(
            "log_id", "win_start", "win_end", "on_time", "late_in_bound", "closed AS fired",
            f"CASE WHEN closed THEN on_time + {late} END AS emitted",
            f"CASE WHEN NOT closed THEN 0L WHEN on_time > 0 THEN 1L + {late} ELSE greatest({late}, {int(late == '0L')}L) END AS panes",
            f"on_time = 0 AND {str(late != '0L').lower()} AS opened_after_close")

    def verdict(self, log: DataFrame) -> DataFrame:
        """Audit the tables of the stream against a batch count of the whole log."""
        config = self.tables.config
        truth = batch_windows(log, config.window_ms, config.offset_ms)
        return audit.verdict_windows(self.windows, truth, self.side_output, self.logs.selectExpr("log_id", "w AS w_last"), config)


def in_parts(index: DataFrame, parts: int) -> DataFrame:
    """Indexed rows stored by ``part_n``, the part of the longest log that their position
    ``i`` lies in, so that each part is read by itself."""
    path, total = new_path(index.sparkSession, "parts"), index.agg({"i": "max"}).first()[0] + 1
    placed = index.selectExpr("*", f"CAST(((i + 1) * {parts} - 1) DIV {total} AS INT) AS part_n").drop("i")
    placed.write.partitionBy("part_n").parquet(path)
    return index.sparkSession.read.schema(placed.schema).parquet(path)


def replay_in_batches(log: DataFrame, order: list[str], config: Config, batches: int, whole_every: int = 16) -> FoldResult:
    """Stream a stored log in so many micro-batches, stopping and restarting the
    query after each one from its checkpoint."""
    spark = log.sparkSession
    source, target, checkpoint = (new_path(spark, name) for name in ("replay", "fold", "checkpoint"))
    parts = in_parts(index_log(log, order).rows.select(*dict.fromkeys(["log_id", "t", *order, "i"])), batches)
    tables = FoldTables(spark, target, config, tuple(order), whole_every)
    for n in range(batches):
        part = parts.where(f"part_n = {n}").drop("part_n")
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        tables.start(stream, checkpoint, availableNow=True).awaitTermination()
    return FoldResult(tables, batches - 1)
