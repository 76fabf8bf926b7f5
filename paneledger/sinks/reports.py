"""Writers: event logs as NDJSON, run tables, reports and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.functions.text import human_ms, lateness_text
from paneledger.names import END_OF_STREAM
from paneledger.operators.panes import PANE_ORDER
from paneledger.plans.compare import same_rows
from paneledger.plans.run import Run

RUN_TABLES = ["counters", "windows", "panes", "side_output", "trace", "verdict", "findings", "lateness"]
# Total order of each table of a run.
TABLE_ORDER = {
    "counters": ["log_id"], "windows": ["log_id", "win_start"], "panes": PANE_ORDER, "side_output": ["log_id", "index"],
    "trace": ["log_id", "index"], "verdict": ["log_id", "win_start"], "findings": ["log_id", "code", "win_start"],
    "lateness": ["log_id"],
}
WATERMARKS = ["watermark", "fired_at_watermark", "collected_at_watermark"]


def write_ndjson(log: DataFrame, path: str, order: list[str]) -> None:
    """One ``{"t", "p", "k"}`` object per line, files and lines in arrival order."""
    lines = log.selectExpr(*order, "to_json(named_struct('t', t, 'p', p, 'k', k), map('ignoreNullFields', 'false')) AS value")
    lines.orderBy(*order).select("value").write.text(path)


def portable(table: DataFrame) -> DataFrame:
    """Watermarks as text, with the end of stream as ``+inf``."""
    rendered = [
        f"CASE WHEN {c} = {END_OF_STREAM}L THEN '+inf' ELSE CAST({c} AS STRING) END AS {c}" if c in WATERMARKS else c
        for c in table.columns
    ]
    return table.selectExpr(*rendered)


def write_run(run: Run, path: str) -> None:
    """Every table of a run as sorted JSON lines, byte-comparable between runs."""
    for name in RUN_TABLES:
        table = getattr(run, name)
        ordered = table.selectExpr("*").orderBy(*[_sort(table, c) for c in TABLE_ORDER[name]])
        portable(ordered).write.json(f"{path}/{name}", ignoreNullFields=False)


def _sort(table: DataFrame, column: str):
    return table[column.removesuffix(" DESC")].desc() if column.endswith(" DESC") else table[column]


def run_fingerprint(run: Run) -> DataFrame:
    """Rows and an order-free hash of every table, empty ones too: equal for equal
    runs. A row is hashed with its nulls in place."""
    parts = []
    for name in RUN_TABLES:
        row = "xxhash64(to_json(struct(*), map('ignoreNullFields', 'false')))"
        hashed = getattr(run, name).selectExpr(f"CAST({row} AS DECIMAL(38, 0)) AS h")
        parts.append(hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("fingerprint"))
                     .selectExpr(f"'{name}' AS table_name", "rows", "fingerprint"))
    return reduce(DataFrame.unionByName, parts)


def report_json(table: DataFrame) -> DataFrame:
    """A table as one JSON text per row."""
    return portable(table).selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) AS report")


def verdict_text(run: Run, log_id: str, shown: int = 8) -> list[str]:
    """The one-screen verdict of one log: counts, reasons, the first findings."""
    mine = lambda df: df.where(df["log_id"] == log_id)
    size = run.judged.sparkSession.range(1).selectExpr(f"{human_ms(f'{run.config.window_ms}L')} AS size").first().size
    row = mine(run.outcome_counts).first()
    if row is None:
        return ["(no events)"]
    lines = [f"{row.complete} complete   {row.revised} revised   {row.unverifiable} unverifiable   ({row.total} windows of {size})"]
    lines += [f"  unverifiable because {r.reason}: {r.windows}" for r in mine(run.reasons).orderBy("reason").collect()]
    if row.findings == 0:
        return [*lines, "  no findings"]
    lines.append(f"  {row.findings} finding(s):")
    first = mine(run.findings).orderBy("code", "win_start").limit(shown).collect()
    lines += [f"    {f.code}{'' if f.win_start is None else f' [{f.win_start}]'}: {f.detail}" for f in first]
    return lines + ([f"    ... {row.findings - shown} more"] if row.findings > shown else [])


def lateness_lines(profile: DataFrame) -> DataFrame:
    return profile.selectExpr("log_id", f"{lateness_text()} AS lateness")


def stale(current: DataFrame, path: str) -> DataFrame:
    """Compare a table with the copy written earlier at ``path``."""
    return same_rows(current, current.sparkSession.read.schema(current.schema).parquet(path))
