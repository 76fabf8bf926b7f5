"""Public feeds, as landed files, turned into event logs.

Each keeps its arrival order; ``first`` takes the first so many arrivals, a
contiguous slice and not a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneledger.functions.times import iso_ms, seconds_ms
from paneledger.operators.scan import ordered_scan, running_index
from paneledger.sources.ndjson import numbered_lines


def _first(log: DataFrame, order: list[str], first: int | None) -> DataFrame:
    """Number the arrivals from 0 in ``seq``, and keep the first ones."""
    rows = ordered_scan(log, ["log_id"], order, {"seq": running_index("seq")}).rows
    rows = rows if first is None else rows.where(f"seq < {first}")
    return rows.select("log_id", "seq", "t", "p", "k")


def archive_log(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Hourly archive of public repository events: JSON lines (gzip or not) in arrival
    order, hours by number. A line without a readable time raises, with its place."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    events = lines.selectExpr("path", "file", "line", "from_json(value, 'created_at STRING, type STRING') AS e").selectExpr(
        "'gharchive' AS log_id", "path", "file", "line", f"{iso_ms('e.created_at')} AS t", "CAST(NULL AS BIGINT) AS p", "e.type AS k")
    bad = events.where("t IS NULL").selectExpr("min(struct(file, line, path)) AS at").first().at
    if bad is not None:
        raise ValueError(f"{bad.path}:{bad.line}: no readable created_at")
    return _first(events, ["file", "path", "line"], first)


def earthquake_log(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Earthquake catalogue (GeoJSON): arrival is the order of (updated, time)."""
    schema = "features ARRAY<STRUCT<id: STRING, properties: STRUCT<time: BIGINT, updated: BIGINT, net: STRING>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).selectExpr(
        "_metadata.file_path AS path", "posexplode(features) AS (pos, f)")
    events = features.selectExpr(
        "'usgs' AS log_id", "f.properties.time AS t", "f.properties.updated AS p", "f.properties.net AS k", "path", "pos")
    return _first(events.where("t IS NOT NULL AND p IS NOT NULL"), ["p", "t", "path", "pos"], first)


def change_log(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Captured server-sent events of recent changes; other and malformed lines are dropped."""
    schema = "timestamp DOUBLE, meta STRUCT<dt: STRING>, server_name STRING"
    data = numbered_lines(spark, path).where("startswith(value, 'data: ')")
    events = data.selectExpr("path", "file", "line", f"from_json(substring(value, 7), '{schema}') AS e").selectExpr(
        "'wikimedia' AS log_id", "path", "file", "line", f"{seconds_ms('e.timestamp')} AS t", f"{iso_ms('e.meta.dt')} AS p",
        "coalesce(e.server_name, 'unknown') AS k")
    return _first(events.where("t IS NOT NULL AND p IS NOT NULL"), ["file", "path", "line"], first)
