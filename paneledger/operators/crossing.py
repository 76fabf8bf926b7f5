"""When the watermark first reached a threshold.

Thresholds lie on a grid of window size (window ends, and window ends plus the
allowed lateness), so only the events that carry the watermark over a grid line
matter: at most one per line. The nearest such event at or above each threshold
is then the last value over both kinds of rows in descending grid order, inside the
block of the log in which the watermark gets there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.config import Config
from paneledger.operators.judge import aggregates

FIRE, RELEASE = "fire", "release"
HIT = "named_struct('index', i, 'watermark', w_after, 't', t)"


def grid_line(value: str, shift: int, window_ms: int) -> str:
    """The last grid line at or below ``value``, as a time."""
    return f"{value} - pmod({value} - ({shift}L), {window_ms}L)"


def grids(config: Config, kinds: list[str]) -> dict[str, int]:
    """Where the grid of each kind of threshold lies. Allowed lateness of whole windows
    leaves one grid for both, and events pass its lines for both."""
    shifts = {FIRE: config.offset_ms, RELEASE: config.offset_ms + config.allowed_lateness_ms}
    return {kind: shifts[kind] % config.window_ms for kind in kinds}


def grid_steps(judged: DataFrame, config: Config, kinds: list[str]) -> DataFrame:
    """Events whose watermark passes a grid line: ``(log_id, blk, grid, line, hit)``."""
    steps = []
    for grid in dict.fromkeys(grids(config, kinds).values()):
        line = grid_line("w_after", grid, config.window_ms)
        line_before = grid_line("w_before", grid, config.window_ms)
        steps.append(f"named_struct('grid', {grid}L, 'line', {line}, 'passed', {line_before} IS NULL OR {line} > {line_before})")
    moved = judged.where("w_after IS NOT NULL AND NOT (w_after <=> w_before)")
    return (
        moved.selectExpr("log_id", "blk", f"{HIT} AS hit", f"explode(array({', '.join(steps)})) AS step")
        .where("step.passed").selectExpr("log_id", "blk", "step.grid", "step.line", "hit")
    )


# The first block that reaches the line, by a binary search: how many do not. A line that
# none reaches meets no step, in whatever part of the log it is.
_BITS = ", ".join(str(1 << bit) for bit in reversed(range(20)))
_BELOW = "pos + bit <= size(ends) AND coalesce(get(ends, pos + bit - 1).reached < line, true)"
FIRST_BLOCK = (
    f"coalesce(get(ends, reduce(array({_BITS}), 0, (pos, bit) -> IF({_BELOW}, pos + bit, pos))).blk, "
    "-1L - pmod(xxhash64(win_start), 1024L))")


def _block_ends(judged: DataFrame) -> DataFrame:
    """The watermark at the end of each block of the logs that were cut, as one ascending
    array per log. A block has one entry at most, so the table may be broadcast."""
    ends = judged.groupBy("log_id", "blk").agg(*aggregates(reached="max(w_after)"))
    return ends.groupBy("log_id").agg(*aggregates(ends="array_sort(collect_list(named_struct('blk', CAST(blk AS BIGINT), 'reached', reached)))")).where(
        "size(ends) > 1")


def _placed(rows: DataFrame, ends: DataFrame, part: str) -> DataFrame:
    return rows.join(F.broadcast(ends), "log_id", "left").selectExpr(
        *rows.columns, f"CASE WHEN ends IS NULL THEN 0L ELSE {part} END AS part")


def crossings(judged: DataFrame, windows: DataFrame, config: Config, kinds: list[str]) -> DataFrame:
    """Per (log, window): ``fire`` and/or ``release``, each ``struct<index,
    watermark, t>`` of the event that first carried the watermark to the
    window's end, or to its end plus allowed lateness; NULL if none did.

    The watermark never falls, so a log's blocks cut the grid as they cut the log: the
    step that meets a threshold lies in the first block that ends at or above it. Steps
    and thresholds meet there, in descending order, by the last step seen.
    """
    at = {FIRE: "win_end", RELEASE: f"win_end + {config.allowed_lateness_ms}L"}
    lines = ", ".join(f"named_struct('kind', '{k}', 'grid', {grid}L, 'line', {at[k]})" for k, grid in grids(config, kinds).items())
    thresholds = windows.selectExpr("log_id", "win_start", f"inline(array({lines}))")
    ends = _block_ends(judged)
    steps = _placed(grid_steps(judged, config, kinds), ends, "CAST(blk AS BIGINT)").drop("blk")
    asked = _placed(thresholds, ends, FIRST_BLOCK)
    both = steps.unionByName(asked, allowMissingColumns=True)
    # Descending lines; on one line the step comes before the threshold it meets.
    nearest = "last(hit, true) OVER (PARTITION BY log_id, part, grid ORDER BY line DESC, win_start IS NOT NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    found = both.selectExpr("*", f"{nearest} AS met").where("win_start IS NOT NULL")
    if len(kinds) == 1:
        return found.selectExpr("log_id", "win_start", f"met AS {kinds[0]}")
    parts = {f"{k}_{field}": f"max(met.{field}) FILTER (WHERE kind = '{k}')" for k in kinds for field in ("index", "watermark", "t")}
    return found.groupBy("log_id", "win_start").agg(*aggregates(**parts)).selectExpr("log_id", "win_start", *[
        f"CASE WHEN {k}_index IS NOT NULL THEN named_struct('index', {k}_index, 'watermark', {k}_watermark, 't', {k}_t) END AS {k}"
        for k in kinds])
