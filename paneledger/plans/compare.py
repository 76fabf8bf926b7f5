"""Runs side by side: profiles of many logs under many configurations, the
inclusive-boundary experiment, and the ordered control."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneledger.config import Config, WatermarkSpec
from paneledger.operators import audit
from paneledger.operators.arrival import ArrivalIndex, index_log
from paneledger.operators.judge import aggregates, judge
from paneledger.operators.truth import lateness_profile, stream_stats
from paneledger.operators.watermarks import attach_watermark
from paneledger.plans.run import Run
from paneledger.sources.logs import NAMED_LOGS, named_log
from paneledger.workspace import remember

# Fixed configurations of a profile: two constant bounds and a measured one.
PROFILE_CONFIGS = {
    "bounded-1s": WatermarkSpec("bounded", bound_ms=1_000),
    "bounded-60s": WatermarkSpec("bounded", bound_ms=60_000),
    "percentile-p99": WatermarkSpec("percentile", percentile=0.99, sample_size=512, floor_ms=1_000),
}


@dataclass(frozen=True)
class Profiled:
    """Logs of one window size, indexed together, so that one job covers them."""

    window_ms: int
    index: ArrivalIndex

    def config(self, spec: WatermarkSpec) -> Config:
        return Config(self.window_ms, 0, self.window_ms, "update", "idle", spec)


def index_named(spark: SparkSession, folder: str, names: list[str]) -> list[Profiled]:
    """Index named logs, one index per window size. Where no processing time was
    recorded, the rest of the order decides."""
    by_size: dict[int, list] = {}
    for name in names:
        by_size.setdefault(named_log(name).window_ms, []).append(named_log(name))
    return [
        Profiled(size, index_log(
            reduce(DataFrame.unionByName, [log.load(spark, folder) for log in logs]).selectExpr("*", "coalesce(p, 0L) AS place"),
            ["place", "seq"], ["p"]))
        for size, logs in by_size.items()
    ]


# Between a log's name and a configuration's, in the name of a log under that configuration.
UNDER = "\u241f"


class SideBySide(Run):
    """A run of the same logs under several watermarks at once: each log once under each,
    as a log of its own. Whatever follows the watermark is planned and run once for all."""

    def __init__(self, index: ArrivalIndex, config: Config, specs: dict[str, WatermarkSpec]) -> None:
        super().__init__(index, config)
        object.__setattr__(self, "specs", specs)

    @cached_property
    def judged(self) -> DataFrame:
        sides = []
        for name, spec in self.specs.items():
            rows = judge(attach_watermark(self.index.rows, spec, self.index.total), self.config)
            sides.append(rows.selectExpr(f"concat(log_id, '{UNDER}{name}') AS log_id", *[c for c in rows.columns if c != "log_id"]))
        return reduce(DataFrame.unionByName, sides)

    @cached_property
    def health_findings(self) -> DataFrame:
        """A raw watermark that falls accuses only where it is promised not to."""
        return audit.overshoot_findings(self.health).unionByName(
            audit.regression_findings(self.health.where(self._named(lambda spec: spec.monotonic))))

    def _named(self, chosen: Callable[[WatermarkSpec], bool]) -> str:
        names = [f"'{name}'" for name, spec in self.specs.items() if chosen(spec)]
        return f"{CONFIG} IN ({', '.join([*names, 'NULL'])})"


CONFIG, PLAIN = f"substring_index(log_id, '{UNDER}', -1)", f"substring_index(log_id, '{UNDER}', 1)"


def matrix_rows(run: SideBySide) -> DataFrame:
    """Everything a profile keeps of runs side by side, per log and configuration."""
    health = run.health.select("log_id", "watermark_overshoots", "watermark_regressions")
    counters = run.counters.selectExpr("log_id", "too_late AS side_output", "revisions_emitted", "opened_after_close")
    one_pane = run.counts.groupBy("log_id").agg(*aggregates(late_with_one_pane="count_if(late_in_bound > 0 AND panes = 1)"))
    out = run.outcome_counts.withColumnRenamed("all_receipted", "windows_all_receipted")
    for part in (health, counters, one_pane):
        out = out.join(part, "log_id", "left")
    adaptive = run._named(lambda spec: not spec.monotonic)
    return out.selectExpr(
        f"{PLAIN} AS log_id", f"{CONFIG} AS config", "complete", "revised", "unverifiable", "total", "findings",
        "watermark_overshoots", "watermark_regressions", "side_output", "revisions_emitted", "opened_after_close",
        "windows_all_receipted", "coalesce(late_with_one_pane, 0L) AS late_with_one_pane",
        f"watermark_regressions > 0 AND coalesce({adaptive}, false) AS adaptive_regression",
    )


def profile_matrix(logs: list[Profiled], specs: dict[str, WatermarkSpec] = PROFILE_CONFIGS) -> DataFrame:
    """Every log under every configuration."""
    first = next(iter(specs.values()))
    return reduce(DataFrame.unionByName, [matrix_rows(SideBySide(log.index, log.config(first), specs)) for log in logs])


def profile_total(matrix: DataFrame) -> DataFrame:
    """Runs and findings over a whole profile."""
    return matrix.agg(*aggregates(runs="count(1)", findings="coalesce(sum(findings), 0L)"))


def retired_conditions(matrix: DataFrame) -> DataFrame:
    """Conditions that look like defects and are not, over a whole profile."""
    counted = matrix.agg(*aggregates(
        no_pane_after_close="sum(windows_all_receipted)", unrevised_late="sum(late_with_one_pane)",
        watermark_regression="count_if(adaptive_regression)"))
    return counted.selectExpr("*", "no_pane_after_close + unrevised_late + watermark_regression AS total")


def boundary_experiment(logs: list[Profiled], bound_ms: int = 0) -> DataFrame:
    """Late events with and without the inclusive-boundary correction, per log."""
    specs = {name: WatermarkSpec(name, bound_ms=bound_ms) for name in ("bounded", "bounded-naive")}
    late = reduce(DataFrame.unionByName, [
        SideBySide(log.index, log.config(specs["bounded"]), specs).counters.selectExpr(
            f"{PLAIN} AS log_id", f"{CONFIG} AS config", "late_in_bound + too_late AS late") for log in logs])
    return late.groupBy("log_id").agg(*aggregates(
        late_bounded="max(late) FILTER (WHERE config = 'bounded')", late_naive="max(late) FILTER (WHERE config = 'bounded-naive')",
    )).selectExpr("*", "late_naive - late_bounded AS extra_late")


def control_sweep(index: ArrivalIndex, config: Config) -> DataFrame:
    """The negative control over many ordered logs in one job: flushed, nothing may
    be revised, unverifiable or accused; idle, only the tail is unverified."""
    idle = Run(index, replace(config, termination="idle"))
    flushed = idle.ended("flush").outcome_counts
    tail = idle.reasons.groupBy("log_id").agg(*aggregates(only_tail="every(reason = 'watermark-never-reached')"))
    sides = flushed.selectExpr("log_id", "revised", "unverifiable", "findings").join(
        idle.outcome_counts.join(tail, "log_id", "left").selectExpr(
            "log_id", "findings AS idle_findings", "revised = 0 AND unverifiable >= 1 AND only_tail AS tail_only"), "log_id")
    return sides.agg(*aggregates(
        logs="count(1)", revised="sum(revised)", unverifiable="sum(unverifiable)", findings="sum(findings)",
        idle_findings="sum(idle_findings)", idle_tail_only="count_if(tail_only)"))


def profile_streams(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The catalogue: statistics and lateness profile of named logs."""
    parts = []
    for log in index_named(spark, folder, names or list(NAMED_LOGS)):
        stats, profile = stream_stats(log.index.events), lateness_profile(log.index.rows)
        parts.append(stats.join(profile.drop("events"), "log_id").selectExpr("*", f"{log.window_ms}L AS window_ms"))
    return reduce(DataFrame.unionByName, parts)


# Buckets of rows that two tables are compared by.
BUCKETS = 4_096


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with two independent hashes of its rows; a null is hashed as one."""
    cells = ", ".join(f"`{c}` IS NULL, `{c}`" for c in df.columns)
    return df.selectExpr("*", f"xxhash64({cells}) AS row_hash", f"xxhash64(7, {cells}) AS row_check")


def fingerprints(df: DataFrame) -> DataFrame:
    """``(bucket, rows, total, check)``: the upper level of a hash tree over the rows, BUCKETS
    rows at most, whatever their order. Sums tell repeated rows; tasks sum before they shuffle."""
    part = "CAST({h} AS DECIMAL(20, 0))"
    return _hashed(df).groupBy(F.expr(f"pmod(row_hash, {BUCKETS})").alias("bucket")).agg(*aggregates(
        rows="count(1)", total=f"sum({part.format(h='row_hash')})", check=f"sum({part.format(h='row_check')})"))


def _compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets of both sides, and whether they hold the same rows."""
    sides = fingerprints(left).join(
        fingerprints(right).withColumnsRenamed({"rows": "other_rows", "total": "other_total", "check": "other_check"}), "bucket", "full_outer")
    return sides.selectExpr(
        "bucket", "coalesce(rows, 0L) AS left_rows", "coalesce(other_rows, 0L) AS right_rows",
        "rows <=> other_rows AND total <=> other_total AND check <=> other_check AS equal")


def changed_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that one table has more often than the other, with ``only_left`` and
    ``only_right`` times. Buckets that agree are never read again by row, so nothing but
    their sums is shuffled for equal tables."""
    return _changed(left, right, _compared(left, right))


def _changed(left: DataFrame, right: DataFrame, compared: DataFrame) -> DataFrame:
    columns = [f"`{c}`" for c in left.columns]
    return _differing(left, right, F.broadcast(compared.where("NOT equal").select("bucket"))).selectExpr(
        *columns, "greatest(l - r, 0L) AS only_left", "greatest(r - l, 0L) AS only_right").where("only_left + only_right > 0")


def _differing(left: DataFrame, right: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of these buckets, at most BUCKETS in number, with their times on each side."""
    columns = [f"`{c}`" for c in left.columns]

    def rows(df: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
        held = _hashed(df).selectExpr(*columns, f"pmod(row_hash, {BUCKETS}) AS bucket").join(buckets, "bucket", "left_semi")
        return held.selectExpr(*columns, f"{l}L AS l", f"{r}L AS r")

    both = rows(left, 1, 0).unionAll(rows(right.select(*left.columns), 0, 1))
    return both.groupBy(*left.columns).agg(*aggregates(l="sum(l)", r="sum(r)"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Replay and staleness check: rows on each side, and rows only on one. The sums of
    the buckets, BUCKETS rows at most, are taken once, by a job of their own; the tables
    are read a second time only if any differ."""
    sides = remember(_compared(left, right))
    totals = sides.agg(*aggregates(left_rows="coalesce(sum(left_rows), 0L)", right_rows="coalesce(sum(right_rows), 0L)"))
    if sides.where("NOT equal").isEmpty():
        return totals.selectExpr("*", "0L AS only_left", "0L AS only_right")
    changed = _changed(left, right, sides).agg(*aggregates(
        only_left="coalesce(sum(only_left), 0L)", only_right="coalesce(sum(only_right), 0L)"))
    return totals.withColumn("one", F.lit(1)).join(changed.withColumn("one", F.lit(1)), "one").drop("one")
