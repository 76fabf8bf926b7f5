"""Event logs from text files, where the line order is the arrival order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr

from paneledger.operators.scan import ordered_scan, running_index

NOT_JSON = "not valid JSON"
NO_TIME = 'every line needs a finite whole number "t" (event time in ms)'
# The largest integer that a JSON number holds exactly.
MAX_EXACT = 9007199254740992


def file_order(path: str) -> str:
    """SQL of a text that sorts file names by the numbers in them: every run of digits
    is led by its length, so that hour 3 comes before hour 10."""
    plain = f"regexp_replace({path}, '(?<![0-9])0+(?=[0-9])', '')"
    return (
        f"array_join(transform(split({plain}, '(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])'), "
        "x -> IF(x RLIKE '^[0-9]', concat(lpad(length(x), 4, '0'), x), x)), '')")


def numbered_lines(spark: SparkSession, path: str, blocks: int | None = None, one_log: bool = False) -> DataFrame:
    """``(path, file, line, value)``: every line of the text files with its 1-based
    number in its file, however the files were split for reading; ``file`` sorts the files. With ``one_log``
    the files are one text in order of their names, and the number runs on."""
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        raise ValueError(f"cannot read {path}: {error.getCondition() or error}") from None
    placed = text.selectExpr(
        "value", "_metadata.file_path AS path", f"{file_order('_metadata.file_path')} AS file", "_metadata.file_block_start AS split",
        "monotonically_increasing_id() AS place")
    if one_log:
        placed = placed.selectExpr("*", "'log' AS text")
    by, order = (["text"], ["file", "path", "split", "place"]) if one_log else (["path"], ["split", "place"])
    lines = ordered_scan(placed, by, order, {"n": running_index("n")}, blocks).rows
    return lines.selectExpr("path", "file", "n + 1 AS line", "value")


@dataclass(frozen=True)
class ParsedLog:
    """Lines with their fields, and a ``reason`` where one was rejected."""

    checked: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.checked.where("reason IS NULL").selectExpr(
            "log_id", "line AS seq", "CAST(t AS BIGINT) AS t",
            f"CASE WHEN abs(p) <= {MAX_EXACT} THEN CAST(p AS BIGINT) END AS p", "k")

    @property
    def bad_lines(self) -> DataFrame:
        return self.checked.where("reason IS NOT NULL").select("log_id", "line", "reason")


def parse_ndjson(lines: DataFrame, log_id: str = "path", unit_ms: int = 1, fraction: str = "reject") -> ParsedLog:
    """Parse numbered lines of ``{"t", "p", "k"}``. Blank lines are skipped; a bad
    ``p`` is NULL, a ``k`` that is not text is empty; a bad ``t`` rejects the line.

    ``t`` and ``p`` are in units of ``unit_ms``. Times inside the library are whole
    milliseconds: what is none after that is a bad ``t`` by default, or goes down
    (``floor``) or to the nearest one (``round``, halves up)."""
    whole = {"reject": "{}", "floor": "floor({})", "round": "floor({} + 0.5D)"}.get(fraction)
    if whole is None:
        raise ValueError(f"unknown fraction {fraction!r}; known: reject, floor, round")
    lines = lines.where("trim(value) <> ''").selectExpr(f"{log_id} AS log_id", "line", "try_parse_json(value) AS v")
    fields = lines.selectExpr(
        "log_id", "line", "v IS NULL AS broken", "schema_of_variant(try_variant_get(v, '$.k')) = 'STRING' AS named",
        *[_number(name) for name in ("t", "p")], "try_variant_get(v, '$.k', 'STRING') AS k")
    fields = fields.withColumns({name: expr(whole.format(f"{name} * {unit_ms}")) for name in ("t", "p")})
    return ParsedLog(fields.selectExpr(
        "log_id", "line", "t", "p", "IF(named, k, '') AS k",
        f"CASE WHEN broken THEN '{NOT_JSON}' WHEN t IS NULL OR abs(t) > {MAX_EXACT} OR t <> floor(t) THEN '{NO_TIME}' END AS reason"))


def _number(name: str) -> str:
    """A number field as DOUBLE; NULL if it is a text, or none."""
    field = f"try_variant_get(v, '$.{name}')"
    return f"IF(schema_of_variant({field}) RLIKE 'STRING|BOOLEAN|OBJECT|ARRAY|VOID', NULL, try_variant_get(v, '$.{name}', 'DOUBLE')) AS {name}"


def read_ndjson(
    spark: SparkSession, path: str, on_bad: str = "fail", one_log: bool = False, unit_ms: int = 1, fraction: str = "reject",
) -> ParsedLog:
    """Read a log per file, or with ``one_log`` a folder that was written in order.
    ``on_bad='fail'`` raises on the first bad line with its number,
    ``'quarantine'`` leaves bad lines to the caller; ``unit_ms`` and ``fraction`` are
    those of ``parse_ndjson``."""
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(f"unknown on_bad {on_bad!r}; known: fail, quarantine")
    label = path.replace("'", "")
    parsed = parse_ndjson(numbered_lines(spark, path, one_log=one_log), f"'{label}'" if one_log else "path", unit_ms, fraction)
    found = parsed.checked.selectExpr(
        "min(struct(log_id, line, reason)) FILTER (WHERE reason IS NOT NULL) AS bad", "count_if(reason IS NULL) AS good").first()
    if on_bad == "fail" and found.bad:
        raise ValueError(f"{found.bad.log_id}:{found.bad.line}: {found.bad.reason}")
    if not found.good:
        raise ValueError(f"{path}: no events found")
    return parsed
