"""Running values over one ordered sequence of any length.

``Window.partitionBy(log_id).orderBy(seq)`` puts a whole log into one task, so
running values are computed in two levels. Rows are cut into blocks along (group,
order), which cuts even a single group; a window inside each (group, block) gives
local running values; the last values of the blocks before, the *carry*, are added
on read. The block is a pure expression of the row's keys over a bounded array of
split points, which one job samples, so it is the same whenever a task runs again,
one shuffle by (group, block) suffices, and inputs of every size take the same path.
The ordered rows are stored, which ends their lineage: readers scan the columns they
need. The carry has rows only for groups that were cut, and each of the ``blocks - 1``
cuts is inside one group at most: no more than two rows per block, whatever the data,
so it may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from paneledger.workspace import keep, remember

UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# Rows per block if there are partitions enough, and rows sampled per split point.
ROWS_PER_BLOCK, SAMPLES_PER_BLOCK = 4_096, 8
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@dataclass(frozen=True)
class Running:
    """One running value, as SQL.

    ``local`` is the value inside a block, over the named frames ``{up_to}`` and
    ``{before}``; ``block`` is what a block passes on, read from its last row;
    ``carry`` folds that (``{value}``) over ``{before}`` or ``{whole}``, the blocks
    before or all blocks of the group; ``join`` combines ``{here}`` and ``{carried}``.
    """

    local: str
    block: str
    carry: str
    join: str


def running_index(name: str) -> Running:
    """0-based position in the group."""
    return Running("CAST(row_number() {order} AS BIGINT) - 1", f"{name} + 1",
                   "sum({value}) {before}", "{here} + coalesce({carried}, 0L)")


def running_sum(name: str, value: str) -> Running:
    """Sum of non-negative values up to and including the row."""
    return Running(f"sum({value}) {{up_to}}", name, "sum({value}) {before}", "{here} + coalesce({carried}, 0L)")


def running_max(name: str, value: str) -> Running:
    """Largest value up to and including the row."""
    return Running(f"max({value}) {{up_to}}", name, "max({value}) {before}", "greatest({here}, {carried})")


def running_max_before(name_up_to: str, value: str) -> Running:
    """Largest value before the row; ``name_up_to`` is the column that includes it."""
    return Running(f"max({value}) {{before}}", name_up_to, "max({value}) {before}", "greatest({here}, {carried})")


def first_of_group(name: str, value: str) -> Running:
    """The value of the group's first row."""
    return Running(f"first({value}) {{up_to}}", name, "first({value}) {whole}", "coalesce({carried}, {here})")


def last_known(name: str, value: str) -> Running:
    """The latest non-null value up to and including the row."""
    return Running(f"last({value}, true) {{up_to}}", name, "last({value}, true) {before}", "coalesce({here}, {carried})")


def last_known_before(name_up_to: str, value: str) -> Running:
    """The latest non-null value before the row; ``name_up_to`` is the column that includes it."""
    return Running(f"last({value}, true) {{before}}", name_up_to, "last({value}, true) {before}", "coalesce({here}, {carried})")


def frames(by: list[str], order: list[str]) -> dict[str, str]:
    over = f"PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)}"
    return {
        "order": f"OVER ({over})", "up_to": f"OVER ({over} {UP_TO})",
        "before": f"OVER ({over} {BEFORE})", "whole": f"OVER ({over} {WHOLE})",
    }


def block_carry(blocks: DataFrame, by: list[str], running: dict[str, Running]) -> DataFrame:
    """Carry of every block of the groups that were cut, from one row per (group,
    block) with the columns ``block_<name>``."""
    over = frames(by, ["blk"])
    cut = blocks.selectExpr("*", f"count(1) OVER (PARTITION BY {', '.join(by)}) AS n_blocks").where("n_blocks > 1")
    return cut.selectExpr(*by, "blk", *[
        f"{run.carry.format(value=f'block_{name}', **over)} AS carry_{name}" for name, run in running.items()])


def with_carry(rows: DataFrame, carry: DataFrame, by: list[str], running: dict[str, Running]) -> DataFrame:
    """Turn block-local values into values over the whole group."""
    others = [c for c in rows.columns if c not in running]
    return rows.join(F.broadcast(carry), [*by, "blk"], "left").selectExpr(*others, *[
        f"{run.join.format(here=name, carried=f'carry_{name}')} AS {name}" for name, run in running.items()])


@dataclass(frozen=True)
class Scanned:
    """``rows`` has the running values and the block number ``blk``; ``events`` is the
    table below it, for readers that need only the input columns; ``total`` counts them."""

    rows: DataFrame
    events: DataFrame
    total: int


def _expected_rows(df: DataFrame) -> int:
    """How many rows the engine expects, from the sizes of files and of rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return max(1, int(str(plan.stats().sizeInBytes())) // max(1, plan.schema().defaultSize() + 8))


def _sampled(df: DataFrame, keys: list[str], share: float, most: int) -> tuple[int, list[str]]:
    """The rows of ``df`` and, in ascending order, the keys of a ``share`` of them, told
    by hash, as JSON: one job. No more than ``most`` are taken; if there are as many, the
    count is of no use."""
    seen = Observation()
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) <= int(share * (1 << 30))
    chosen = df.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).where(hashed).limit(most)
    found = chosen.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("x")).select(F.transform("x", lambda key: F.to_json(key)).alias("x")).first().x
    return seen.get["n"], found


def split_points(df: DataFrame, keys: list[str], blocks: int | None) -> tuple[int, list[str]]:
    """The rows of ``df``, and ascending keys, as JSON, that cut it into ``blocks`` parts
    of about even size. By default there are twice as many blocks as shuffle partitions,
    or one per ROWS_PER_BLOCK rows if that is less. The share to sample comes from the
    size that the engine expects; where that was far off, a second job mends it."""
    most = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if blocks is None else blocks
    limit = 16 * SAMPLES_PER_BLOCK * most
    total, found = _sampled(df, keys, min(1.0, SAMPLES_PER_BLOCK * most / _expected_rows(df)), limit)
    total = df.count() if len(found) == limit else total
    if not total:
        return 0, []
    if blocks is None:
        most = min(most, -(-total // ROWS_PER_BLOCK))
    enough = min(total, SAMPLES_PER_BLOCK * most)
    if most > 1 and (len(found) < enough // 4 or len(found) == limit):
        _, found = _sampled(df, keys, min(1.0, 2 * enough / total), limit)
    cuts = [found[len(found) * at // most] for at in range(1, most)] if found else []
    return total, list(dict.fromkeys(cuts))


def _as_array(df: DataFrame, keys: list[str], points: list[str]) -> Column:
    """The split points as one constant of the plan."""
    return F.from_json(F.lit(f"[{','.join(points)}]"), ArrayType(StructType([df.schema[key] for key in keys])))


def with_blocks(df: DataFrame, keys: list[str], points: list[str]) -> DataFrame:
    """``df`` with ``blk``, the number of split points at or below the row: a binary
    search in a constant array, one step per bit of their number."""
    if not points:
        return df.selectExpr("*", "0 AS blk")
    ascending = _as_array(df, keys, points)
    found = df.select("*", F.struct(*keys).alias("sort_key"), F.lit(0).alias("blk"))
    others = [c for c in found.columns if c != "blk"]
    for bit in reversed(range(len(points).bit_length())):
        below = F.get(ascending, F.col("blk") + F.lit((1 << bit) - 1)) <= F.col("sort_key")
        found = found.select(*others, (F.col("blk") + F.when(below, F.lit(1 << bit)).otherwise(F.lit(0))).alias("blk"))
    return found.drop("sort_key")


def ordered_scan(
    df: DataFrame, by: list[str], order: list[str], running: dict[str, Running], blocks: int | None = None, derived: bool = False,
) -> Scanned:
    """Add one column per running value.

    (by, order) must be unique, of types that turn into JSON and back. ``blocks``
    fixes the number of blocks. A ``derived`` table is held until the scan is stored,
    as the split points and the scan both read it.
    """
    keys = [*by, *order]
    df = remember(df) if derived else df
    total, points = split_points(df, keys, blocks)
    placed = with_blocks(df, keys, points)
    over = frames([*by, "blk"], order)
    local = [f"{run.local.format(**over)} AS {name}" for name, run in running.items()]
    ends_block = f"lead(true) {over['order']} IS NULL AS ends_block"
    scanned = keep(placed.selectExpr("*", *local, ends_block), "scan")
    if derived:
        df.unpersist()
    if not points:
        scanned = scanned.drop("ends_block")
        return Scanned(scanned, scanned, total)
    # A group is cut if the split point before or after one of its blocks lies in it.
    ascending = _as_array(df, keys, points)
    before, after = (F.get(ascending, F.col("blk") - 1), F.get(ascending, F.col("blk")))
    cut = (reduce(Column.__and__, [before[c].eqNullSafe(F.col(c)) for c in by], F.col("blk") > 0)
           | reduce(Column.__and__, [after[c].eqNullSafe(F.col(c)) for c in by], F.col("blk") < len(points)))
    ends = scanned.where(F.col("ends_block") & cut).selectExpr(
        *by, "blk", *[f"{run.block} AS block_{name}" for name, run in running.items()])
    carry = block_carry(ends, by, running)
    scanned = scanned.drop("ends_block")
    return Scanned(with_carry(scanned, carry, by, running), scanned, total)
