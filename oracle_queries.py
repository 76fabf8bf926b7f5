"""The registered queries once more, as plain SQL for DuckDB.

Each statement is a chain of common table expressions over the given tables: the
log, arrival positions, the watermark, the judged events, the windows. They are
written from the definitions and share nothing with the Spark side.
"""

from __future__ import annotations

HOUR, DAY = 3_600_000, 86_400_000

EVENT_T = "epoch_us(ts) // 1000"
EVENT_P = """epoch_us(ts) // 1000 + CASE WHEN (event_id * 7919) % 100 < 80 THEN 0
    ELSE ((event_id * 104729) % 720) * ((event_id * 104729) % 720) * 83 END"""
ORDER_T = "epoch_us(o_orderdate) // 1000"
ORDER_P = """epoch_us(o_orderdate) // 1000 + CASE WHEN (o_orderkey * 7919) % 100 < 80 THEN 0
    ELSE ((o_orderkey * 104729) % 5) * 86400000 END"""

LOGS = {
    "events": f"SELECT 'events' AS log_id, {EVENT_T} AS t, {EVENT_P} AS p, event_id AS seq, event_type AS k FROM events",
    "events_in_order": f"SELECT 'events_in_order' AS log_id, {EVENT_T} AS t, NULL::BIGINT AS p, event_id AS seq, event_type AS k FROM events",
    "events_by_user": f"SELECT user_id::VARCHAR AS log_id, {EVENT_T} AS t, {EVENT_P} AS p, event_id AS seq, event_type AS k FROM events",
    "users_in_order": f"SELECT user_id::VARCHAR AS log_id, {EVENT_T} AS t, NULL::BIGINT AS p, event_id AS seq, event_type AS k FROM events",
    "orders": f"SELECT 'orders' AS log_id, {ORDER_T} AS t, {ORDER_P} AS p, o_orderkey AS seq, o_orderpriority AS k FROM orders",
}

# The events log moved to before 1970.
LOGS["events_early"] = f"SELECT log_id, t - 4000000000000 AS t, p, seq, k FROM ({LOGS['events']})"
# The events log without the rows that lack their log, time or place.
LOGS["events_kept"] = f"SELECT * FROM ({LOGS['events']}) WHERE seq % 89 <> 0 AND seq % 97 <> 0 AND seq % 101 <> 0"

UP_TO = "(PARTITION BY log_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "(PARTITION BY log_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def index_ctes(log: str) -> str:
    return f"""
ev AS ({LOGS[log]}),
ord AS (SELECT log_id, t, p, seq, k, row_number() OVER (PARTITION BY log_id ORDER BY p, seq) - 1 AS i FROM ev),
mx AS (SELECT *, max(t) OVER {UP_TO} AS m, max(t) OVER {BEFORE} AS mb FROM ord),
idx AS (SELECT *, CASE WHEN mb IS NULL OR mb < t THEN 0 ELSE mb - t END AS lateness_ms FROM mx)"""


def raw_ctes(spec: dict) -> str:
    name = spec["name"]
    if name == "bounded":
        return f"raws AS (SELECT *, m - {spec['bound']} - 1 AS raw FROM idx)"
    if name == "bounded-naive":
        return f"raws AS (SELECT *, m - {spec['bound']} AS raw FROM idx)"
    if name == "processing-time":
        return f"raws AS (SELECT *, first_value(t) OVER (PARTITION BY log_id ORDER BY i) + i * {spec['rate']} AS raw FROM idx)"
    if name == "punctuated":
        n = spec["n"]
        return f"""
grp AS (SELECT log_id, i // {n} AS g, min(t) - 1 AS mark FROM idx GROUP BY ALL HAVING count(*) = {n}),
raws AS (SELECT idx.*, grp.mark AS raw FROM idx LEFT JOIN grp ON grp.log_id = idx.log_id AND grp.g = (idx.i + 1) // {n} - 1)"""
    p, s, floor = spec["p"], spec["s"], spec["floor"]
    return f"""
lats AS (SELECT *, list(CASE WHEN mb IS NOT NULL THEN lateness_ms END)
    OVER (PARTITION BY log_id ORDER BY i ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW) AS l0 FROM idx),
lat1 AS (SELECT * EXCLUDE (l0), list_sort(list_filter(l0, lambda x: x IS NOT NULL)) AS l FROM lats),
raws AS (SELECT * EXCLUDE (l), m - greatest({floor}, CASE WHEN len(l) = 0 THEN 0
    ELSE l[least(len(l), floor({p}::DOUBLE * len(l))::BIGINT + 1)] END) - 1 AS raw FROM lat1)"""


def run_ctes(log: str, spec: dict, size: int, bound: int, policy: str = "update", flush: bool = False, offset: int = 0) -> str:
    """Log to judged events, windows, and what became of each window."""
    update = policy == "update"
    w_final = "NULL" if flush else "max(w_after)"
    reached = "true" if flush else "coalesce(w_final >= win_end, false)"
    discarded = "0" if update else "late_in_bound"
    revisions = "late_in_bound" if update else "0"
    unreached = "false" if flush else "(w_final IS NULL OR w_final < win_end)"
    return f"""WITH {index_ctes(log)}, {raw_ctes(spec)},
wm0 AS (SELECT *, max(raw) OVER {UP_TO} AS w_after FROM raws),
wm AS (SELECT *, lag(w_after) OVER (PARTITION BY log_id ORDER BY i) AS w_before FROM wm0),
j0 AS (SELECT *, t - (((t - {offset}) % {size}) + {size}) % {size} AS win_start FROM wm),
j AS (SELECT *, win_start + {size} AS win_end, CASE WHEN w_before >= win_start + {size} + {bound} THEN 'too_late'
    WHEN w_before >= win_start + {size} THEN 'late_in_bound' ELSE 'on_time' END AS cls FROM j0),
fin AS (SELECT log_id, {w_final} AS w_final, count(*) AS n FROM j GROUP BY log_id),
tal AS (SELECT log_id, win_start, win_end, count(*) AS expected,
    count(*) FILTER (cls = 'on_time') AS on_time, count(*) FILTER (cls = 'late_in_bound') AS late_in_bound,
    count(*) FILTER (cls = 'too_late') AS too_late,
    min(i) FILTER (cls <> 'too_late') AS first_index, max(i) FILTER (cls <> 'too_late') AS last_index,
    min(i) FILTER (cls = 'late_in_bound') AS first_late FROM j GROUP BY ALL),
win AS (SELECT tal.*, w_final, n, {discarded} AS discarded,
    CASE WHEN on_time > 0 THEN CASE WHEN {reached} THEN 1 + {revisions} ELSE 0 END
         WHEN late_in_bound > 0 THEN {'late_in_bound' if update else '1'} ELSE 0 END AS panes,
    on_time + {revisions} AS kept FROM tal JOIN fin USING (log_id)),
ver AS (SELECT log_id, win_start, win_end, expected, CASE WHEN panes > 0 THEN kept END AS emitted, panes,
    too_late + discarded AS receipted,
    CASE WHEN panes = 0 AND {unreached} THEN 'watermark-never-reached'
         WHEN panes = 0 AND too_late + discarded >= expected THEN 'lateness-bound-exceeded'
         WHEN panes = 0 THEN 'no-pane-after-close'
         WHEN kept = expected THEN NULL
         WHEN expected - kept = too_late + discarded AND discarded > 0 THEN 'policy-discard'
         WHEN expected - kept = too_late + discarded THEN 'lateness-bound-exceeded'
         ELSE 'unexplained-shortfall' END AS reason FROM win),
verdict AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unverifiable' WHEN panes > 1 THEN 'revised'
    ELSE 'complete' END AS outcome FROM ver),
steps AS (SELECT log_id, i, w_after, t, cls FROM j WHERE w_after IS DISTINCT FROM w_before)"""


def fire_ctes(bound: int, flush: bool = False) -> str:
    """When the watermark first reached each window's end, and its release."""
    index = "coalesce({}, n)" if flush else "{}"
    mark = f"coalesce({{}}, {2**63 - 1})" if flush else "{}"
    crossing = lambda shift: f"""(SELECT win.log_id, win_start, min(s.i) AS i, min(s.w_after) AS w, arg_min(s.t, s.i) AS t
        FROM win LEFT JOIN steps s ON s.log_id = win.log_id AND s.w_after >= win_end + {shift}
        WHERE on_time + late_in_bound > 0 GROUP BY ALL)"""  # noqa: E731
    return f""",
f0 AS {crossing(0)},
r0 AS {crossing(bound)},
fire AS (SELECT win.*, {index.format('f0.i')} AS fire_index, {mark.format('f0.w')} AS fire_watermark, f0.t AS fire_t,
    {index.format('r0.i')} AS release_index, {mark.format('r0.w')} AS release_watermark
    FROM win JOIN f0 USING (log_id, win_start) JOIN r0 USING (log_id, win_start))"""


def pane_ctes(policy: str, bound: int, flush: bool = False) -> str:
    update = policy == "update"
    late_rows = """
    UNION ALL SELECT log_id, win_start, win_end,
        CASE WHEN on_time > 0 THEN nth + 1 ELSE nth END, CASE WHEN on_time = 0 AND nth = 1 THEN 'initial' ELSE 'revision' END,
        on_time + nth, CASE WHEN on_time = 0 AND nth = 1 THEN NULL ELSE on_time + nth - 1 END, w_before, i, 0, 0
    FROM nth""" if update else """
    UNION ALL SELECT f.log_id, f.win_start, f.win_end, 1, 'initial', 0, NULL, j.w_after, f.first_late, 1, f.first_index
    FROM fire f JOIN j ON j.log_id = f.log_id AND j.i = f.first_late WHERE on_time = 0"""
    return f"""{fire_ctes(bound, flush)},
nth AS (SELECT j.log_id, j.win_start, j.win_end, j.t, j.i, j.w_before, j.w_after, win.on_time,
    row_number() OVER (PARTITION BY j.log_id, j.win_start ORDER BY j.i) AS nth
    FROM j JOIN win USING (log_id, win_start) WHERE cls = 'late_in_bound'),
panes AS (SELECT log_id, win_start, win_end, 1 AS seq, 'initial' AS kind, on_time AS count, NULL::BIGINT AS retracts,
        fire_watermark AS watermark, fire_index AS at_index, 1 AS turn, first_index AS opened
    FROM fire WHERE on_time > 0 AND fire_index IS NOT NULL {late_rows})"""


def big(*columns: str) -> str:
    return ", ".join(f"{c}::BIGINT AS {c}" for c in columns)


PANES = f"SELECT log_id, {big('win_start', 'win_end', 'seq')}, kind, {big('count', 'retracts', 'watermark', 'at_index')} FROM panes"
PANES_AT_5 = PANES.replace(" FROM", ", {left}::BIGINT AS only_left, {right}::BIGINT AS only_right FROM") + " WHERE at_index % 97 = 5"
VERDICT = f"SELECT log_id, {big('win_start', 'win_end')}, outcome, reason, {big('expected', 'emitted', 'panes', 'receipted')} FROM verdict"
# Windows whose verdict is an accusation, and logs that lost events: expected, but neither counted nor receipted.
FINDINGS = """(count(*) FILTER (reason IN ('no-pane-after-close', 'unexplained-shortfall'))
    + (sum(greatest(expected - coalesce(emitted, 0) - receipted, 0)) FILTER (panes > 0) > 0)::BIGINT)"""
SUMMARY = f"""SELECT log_id, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'revised') AS revised,
    count(*) FILTER (outcome = 'unverifiable') AS unverifiable, count(*) AS total, coalesce({FINDINGS}, 0)::BIGINT AS findings, coalesce({FINDINGS}, 0) = 0 AS clean
    FROM verdict GROUP BY log_id"""
WATERMARK = f"SELECT log_id, {big('i', 'raw', 'w_before', 'w_after')} FROM wm"
SIDE = """SELECT log_id, i::BIGINT AS index, t::BIGINT AS t, win_start::BIGINT AS win_start, win_end::BIGINT AS win_end,
    CASE WHEN cls = 'too_late' THEN concat('beyond allowed lateness: watermark ', w_before, ' >= windowEnd ', win_end,
        ' + allowedLateness {bound}') ELSE 'late but within allowed lateness; policy is side-output' END AS reason,
    (w_before - win_end)::BIGINT AS lateness_ms FROM j WHERE cls IN ({classes})"""

B10M = {"name": "bounded", "bound": 600_000}
P99 = {"name": "percentile", "p": 0.99, "s": 512, "floor": 0}
PUNCT = {"name": "punctuated", "n": 64}
RATE = {"name": "processing-time", "rate": 3_600_000}
LATE = 2 * HOUR

PROFILE = f"""
prof AS (SELECT log_id, count(*) AS events, count(*) FILTER (lateness_ms > 0) AS out_of_order,
    round(100.0::DOUBLE * count(*) FILTER (lateness_ms > 0) / count(*), 4) AS out_of_order_pct,
    list_sort(list(lateness_ms)) AS l FROM idx GROUP BY log_id),
profile AS (SELECT log_id, events::BIGINT AS events, out_of_order::BIGINT AS out_of_order, out_of_order_pct,
    {', '.join(f"l[least(events, floor({p}::DOUBLE * events)::BIGINT + 1)]::BIGINT AS {n}"
               for n, p in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99), ('p999', 0.999)))},
    l[events]::BIGINT AS max_lateness FROM prof),
stats AS (SELECT log_id, count(*) AS events, (max(t) - min(t))::BIGINT AS span_ms, count(DISTINCT t) AS distinct_event_times,
    round(count(*)::DOUBLE / count(DISTINCT t), 2) AS events_per_distinct_time FROM ord GROUP BY log_id)"""


def human(ms: str) -> str:
    """Round on the exact decimal expansion of the double, halves up."""
    def unit(per: int, suffix: str) -> str:
        exact = f"printf('%.40f', abs({ms})::DOUBLE / {per})"
        whole, digit = f"split_part({exact}, '.', 1)::BIGINT", f"substr(split_part({exact}, '.', 2), 1, 1)::BIGINT"
        up = f"(substr(split_part({exact}, '.', 2), 2, 1) >= '5')::BIGINT"
        tenths = f"({whole} * 10 + {digit} + {up})"
        return f"concat(CASE WHEN {ms} < 0 THEN '-' ELSE '' END, {tenths} // 10, '.', {tenths} % 10, '{suffix}')"
    return (
        f"CASE WHEN abs({ms}) < 1000 THEN concat({ms}, 'ms') WHEN abs({ms}) < 60000 THEN {unit(1000, 's')} "
        f"WHEN abs({ms}) < 3600000 THEN {unit(60000, 'm')} WHEN abs({ms}) < 86400000 THEN {unit(3600000, 'h')} "
        f"ELSE {unit(86400000, 'd')} END"
    )


def counters(policy: str) -> str:
    opened = "count(*) FILTER (on_time = 0 AND late_in_bound > 0)" if policy == "update" else "0"
    return f"""SELECT log_id, sum(expected)::BIGINT AS total, sum(on_time)::BIGINT AS on_time,
    sum(late_in_bound)::BIGINT AS late_in_bound, sum(too_late)::BIGINT AS too_late,
    {'sum(late_in_bound)' if policy == 'drop' else '0'}::BIGINT AS dropped_in_bound, 0::BIGINT AS discarded_without_receipt,
    ({'sum(late_in_bound)' if policy == 'update' else '0'} - {opened})::BIGINT AS revisions_emitted,
    {opened}::BIGINT AS opened_after_close FROM tal GROUP BY log_id"""


MATRIX_ROW = """SELECT v.log_id, '{config}' AS config, complete, revised, unverifiable, total, 0::BIGINT AS findings,
    watermark_overshoots, watermark_regressions, side_output, revisions_emitted, opened_after_close, windows_all_receipted,
    late_with_one_pane, {adaptive} AND watermark_regressions > 0 AS adaptive_regression
FROM (SELECT log_id, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'revised') AS revised,
        count(*) FILTER (outcome = 'unverifiable') AS unverifiable, count(*) AS total,
        count(*) FILTER (panes = 0 AND reason = 'lateness-bound-exceeded') AS windows_all_receipted FROM verdict GROUP BY log_id) v
JOIN (SELECT log_id, count(*) FILTER (w_after > m) AS watermark_overshoots, count(*) FILTER (raw < w_after) AS watermark_regressions,
        count(*) FILTER (cls = 'too_late') AS side_output FROM j GROUP BY log_id) h ON h.log_id = v.log_id
JOIN (SELECT log_id, (sum(late_in_bound) - count(*) FILTER (on_time = 0 AND late_in_bound > 0))::BIGINT AS revisions_emitted,
        count(*) FILTER (on_time = 0 AND late_in_bound > 0) AS opened_after_close,
        count(*) FILTER (late_in_bound > 0 AND panes = 1) AS late_with_one_pane FROM win GROUP BY log_id) c ON c.log_id = v.log_id"""

MATRIX_SPECS = {
    "bounded-1s": {"name": "bounded", "bound": 1_000}, "bounded-60s": {"name": "bounded", "bound": 60_000},
    "percentile-p99": {"name": "percentile", "p": 0.99, "s": 512, "floor": 1_000},
}


def matrix() -> str:
    rows = [
        f"SELECT * FROM ({run_ctes(log, spec, size, size)} {MATRIX_ROW.format(config=name, adaptive=str(spec['name'] == 'percentile').lower())})"
        for log, size in (("events", HOUR), ("events_in_order", HOUR), ("orders", DAY)) for name, spec in MATRIX_SPECS.items()]
    return " UNION ALL ".join(rows)


def boundary() -> str:
    def late(log: str, name: str, size: int) -> str:
        spec = {"name": name, "bound": 0}
        return f"({run_ctes(log, spec, size, size)} SELECT log_id, count(*) FILTER (cls <> 'on_time') AS late FROM j GROUP BY log_id)"
    rows = [
        f"SELECT a.log_id, a.late AS late_bounded, b.late AS late_naive, b.late - a.late AS extra_late "
        f"FROM {late(log, 'bounded', size)} a JOIN {late(log, 'bounded-naive', size)} b ON a.log_id = b.log_id"
        for log, size in (("events", HOUR), ("orders", DAY))]
    return " UNION ALL ".join(rows)


def catalog() -> str:
    rows = [
        f"""SELECT * FROM (WITH {index_ctes(log)}, {PROFILE} SELECT s.*, out_of_order, out_of_order_pct, p50, p90, p99, p999,
        max_lateness, {size}::BIGINT AS window_ms FROM stats s JOIN profile p ON s.log_id = p.log_id)"""
        for log, size in (("events", HOUR), ("events_in_order", HOUR), ("events_by_user", HOUR), ("orders", DAY))]
    return " UNION ALL ".join(rows)


def control() -> str:
    flushed = f"{run_ctes('users_in_order', B10M, HOUR, LATE, flush=True)} SELECT log_id, count(*) FILTER (outcome = 'revised') AS r, count(*) FILTER (outcome = 'unverifiable') AS u FROM verdict GROUP BY log_id"
    idle = f"""{run_ctes('users_in_order', B10M, HOUR, LATE)} SELECT log_id, count(*) FILTER (outcome = 'revised') = 0
        AND count(*) FILTER (outcome = 'unverifiable') >= 1 AND bool_and(reason = 'watermark-never-reached') AS tail FROM verdict GROUP BY log_id"""
    return f"""SELECT count(*) AS logs, sum(r)::BIGINT AS revised, sum(u)::BIGINT AS unverifiable, 0::BIGINT AS findings,
        0::BIGINT AS idle_findings, count(*) FILTER (tail) AS idle_tail_only FROM ({flushed}) f JOIN ({idle}) i ON f.log_id = i.log_id"""


def statements() -> dict[str, str]:
    bounded = run_ctes("events", B10M, HOUR, LATE)
    flushed = run_ctes("events", B10M, HOUR, LATE, flush=True)
    drop, side = (run_ctes("events", B10M, HOUR, LATE, policy) for policy in ("drop", "side-output"))
    quantile = run_ctes("events", P99, HOUR, LATE)
    users = run_ctes("events_by_user", B10M, HOUR, LATE)
    rate = run_ctes("events", RATE, HOUR, LATE)
    opened, opened_drop = (run_ctes("events_early", B10M, 60_000, LATE, policy, offset=17_000) for policy in ("update", "drop"))
    ordered = PANES.replace("SELECT", "SELECT row_number() OVER (PARTITION BY log_id ORDER BY at_index, turn, opened) - 1 AS pos,", 1)
    punctuated = run_ctes("events", PUNCT, HOUR, LATE)
    index = f"WITH {index_ctes('events')}"
    too_late = SIDE.format(bound=LATE, classes="'too_late'")
    refused = SIDE.format(bound=LATE, classes="'too_late', 'late_in_bound'")
    steps = f"SELECT log_id, i::BIGINT AS index, w_after::BIGINT AS watermark FROM steps"
    state = f"""{fire_ctes(LATE)} SELECT log_id, {big('win_start', 'win_end')}, kept::BIGINT AS count,
        CASE WHEN panes > 0 THEN kept END::BIGINT AS emitted, panes::BIGINT AS panes, panes > 0 AS fired,
        on_time = 0 AS opened_after_close, {big('on_time', 'late_in_bound', 'too_late', 'first_index', 'last_index')},
        CASE WHEN on_time = 0 THEN (SELECT w_before FROM j WHERE j.log_id = fire.log_id AND j.i = first_late)
            ELSE fire_watermark END::BIGINT AS fired_at_watermark,
        release_watermark::BIGINT AS collected_at_watermark, release_watermark IS NOT NULL AS collected FROM fire"""
    timeline = f"""{pane_ctes('update', LATE)}
        SELECT log_id, i::BIGINT AS index, t::BIGINT AS t, w_after::BIGINT AS watermark,
            CASE WHEN cls = 'too_late' THEN '!' ELSE 'o' END AS mark, win_start::BIGINT AS win_start,
            NULL::BIGINT AS pane_seq, NULL::BIGINT AS count,
            CASE WHEN cls = 'too_late' THEN concat('refused, ', {human('(w_before - win_end)')}, ' after the close') ELSE '' END AS note
        FROM j WHERE cls <> 'late_in_bound'
        UNION ALL SELECT log_id, i, t, w_after, CASE WHEN on_time = 0 AND nth = 1 THEN 'o' ELSE '*' END, win_start,
            CASE WHEN on_time > 0 THEN nth + 1 ELSE nth END, on_time + nth,
            CASE WHEN on_time = 0 AND nth = 1 THEN concat('closed [', win_start, ',', win_end, ') = ', on_time + nth)
                ELSE concat('revised [', win_start, ',', win_end, ') = ', on_time + nth, ' (was ', on_time + nth - 1, ')') END FROM nth
        UNION ALL SELECT log_id, fire_index, fire_t, fire_watermark, '|', win_start, 1, on_time,
            concat('closed [', win_start, ',', win_end, ') = ', on_time) FROM fire WHERE on_time > 0 AND fire_index IS NOT NULL"""
    row_counts = {name: f"{bounded}{pane_ctes('update', LATE)} SELECT count(*) AS n FROM {rows}" for name, rows in {
        "counters": "(SELECT DISTINCT log_id FROM tal)", "windows": "fire", "panes": "panes", "side_output": "j WHERE cls = 'too_late'",
        "trace": "steps", "verdict": "verdict", "findings": "verdict WHERE reason IN ('no-pane-after-close', 'unexplained-shortfall')",
        "lateness": "(SELECT DISTINCT log_id FROM idx)"}.items()}
    finding = "SELECT log_id, '{code}' AS code, 'defect' AS severity, {window}::BIGINT AS win_start, {detail} AS detail FROM {rows}"
    return {
        "tumbling_count": f"{index} SELECT log_id, (t - t % {HOUR})::BIGINT AS win_start, (t - t % {HOUR} + {HOUR})::BIGINT AS win_end, concat(t - t % {HOUR}, '-', t - t % {HOUR} + {HOUR}) AS window_key, count(*) AS count FROM ord GROUP BY ALL",
        "window_key_roundtrip": f"{index} SELECT DISTINCT concat(t - t % {HOUR}, '-', t - t % {HOUR} + {HOUR}) AS window_key, (t - t % {HOUR})::BIGINT AS win_start, (t - t % {HOUR} + {HOUR})::BIGINT AS win_end FROM ord",
        "arrival_order": f"{index} SELECT log_id, {big('i', 't', 'p', 'seq')} FROM ord",
        "log_head": f"{index} SELECT log_id, {big('i', 't')}, k FROM ord WHERE i < 5000",
        "ndjson_scan": f"{index} SELECT (i + 1)::BIGINT AS seq, {big('t', 'p')}, k FROM ord",
        "running_max": f"{index} SELECT log_id, i::BIGINT AS i, m::BIGINT AS max_seen FROM idx",
        "event_lateness": f"{index} SELECT log_id, {big('i', 'lateness_ms')} FROM idx",
        "human_duration": f"{index} SELECT log_id, i::BIGINT AS i, {human('lateness_ms')} AS lateness FROM idx",
        "lateness_profile": f"{index}, {PROFILE} SELECT * FROM profile",
        "stream_stats": f"{index}, {PROFILE} SELECT * FROM stats",
        "stream_catalog": catalog(),
        "wm_bounded": f"{bounded} {WATERMARK}",
        "wm_bounded_naive": f"{run_ctes('events', {'name': 'bounded-naive', 'bound': 600_000}, HOUR, LATE)} {WATERMARK}",
        "wm_percentile": f"{quantile} {WATERMARK}",
        "wm_punctuated": f"{run_ctes('events', PUNCT, HOUR, LATE)} {WATERMARK}",
        "wm_processing_time": f"{rate} {WATERMARK}",
        "watermark_trace": f"{flushed} {steps} UNION ALL SELECT log_id, n::BIGINT, {2**63 - 1}::BIGINT FROM fin",
        "watermark_health": f"""{quantile} SELECT log_id, count(*) AS events, max(w_after)::BIGINT AS w_last,
            count(*) FILTER (w_after > m) AS watermark_overshoots, coalesce(max(w_after - m) FILTER (w_after > m), 0)::BIGINT AS max_overshoot_ms,
            count(*) FILTER (raw < w_after) AS watermark_regressions, coalesce(max(w_after - raw), 0)::BIGINT AS max_regression_ms,
            max(lateness_ms)::BIGINT AS max_lateness_ms, min(t)::BIGINT AS min_event_time, max(t)::BIGINT AS max_event_time FROM j GROUP BY log_id""",
        "event_class": f"{bounded} SELECT log_id, {big('i', 't', 'win_start')}, cls FROM j",
        "run_counters": f"{bounded} {counters('update')}",
        "run_counters_drop": f"{drop} {counters('drop')}",
        "window_state": f"{bounded} {state}",
        "window_fire": f"{bounded}{fire_ctes(LATE)} SELECT log_id, {big('win_start', 'fire_index', 'fire_watermark', 'release_index', 'release_watermark')} FROM fire",
        "panes": f"{bounded}{pane_ctes('update', LATE)} {PANES}",
        "panes_drop": f"{drop}{pane_ctes('drop', LATE)} {PANES}",
        "panes_flush": f"{flushed}{pane_ctes('update', LATE, True)} {PANES}",
        "pane_stream": f"{bounded}{pane_ctes('update', LATE)} {ordered}",
        "pane_stream_flush": f"{flushed}{pane_ctes('update', LATE, True)} {ordered}",
        "changed_panes": f"{bounded}{pane_ctes('update', LATE)} {PANES_AT_5.format(left=1, right=0)} UNION ALL "
            + PANES_AT_5.format(left=0, right=1).replace("count::BIGINT", "(count + 1)::BIGINT"),
        "observed_counters": f"""{quantile} SELECT count(*) AS total, count(*) FILTER (cls = 'on_time') AS on_time,
            count(*) FILTER (cls = 'late_in_bound') AS late_in_bound, count(*) FILTER (cls = 'too_late') AS too_late,
            count(*) FILTER (w_after > m) AS watermark_overshoots, count(*) FILTER (raw < w_after) AS watermark_regressions,
            max(w_after)::BIGINT AS w_last, max(lateness_ms)::BIGINT AS max_lateness_ms FROM j""",
        "foreign_findings": f"""{bounded}{fire_ctes(LATE)},
alt AS (SELECT log_id, i, w_after + CASE WHEN i % 50 = 7 THEN {3 * HOUR} ELSE 0 END AS w FROM steps),
now AS (SELECT j.log_id, j.i, j.m, last_value(alt.w IGNORE NULLS) OVER (PARTITION BY j.log_id ORDER BY j.i) AS w
    FROM j LEFT JOIN alt ON alt.log_id = j.log_id AND alt.i = j.i),
falls AS (SELECT log_id, lag(w) OVER (PARTITION BY log_id ORDER BY i) - w AS fall FROM alt),
gone AS (SELECT f.log_id, win_start, win_end + {LATE} AS owed, w FROM fire f JOIN now
    ON now.log_id = f.log_id AND now.i = CASE WHEN win_start % {5 * HOUR} = 0 THEN fire_index ELSE release_index END)
SELECT log_id, 'watermark-overshoot' AS code, 'defect' AS severity, NULL::BIGINT AS win_start,
    concat(count(*), ' event(s) with the watermark above the highest event time, by up to ', max(w - m), ' ms') AS detail
FROM now WHERE w > m GROUP BY log_id
UNION ALL SELECT log_id, 'watermark-regression', 'defect', NULL,
    concat(count(*), ' fall(s) of a raw watermark that cannot fall, by up to ', max(fall), ' ms') FROM falls WHERE fall > 0 GROUP BY log_id
UNION ALL SELECT log_id, 'premature-close', 'defect', win_start::BIGINT, concat('released at watermark ', w, ', ', owed - w, ' ms too early')
FROM gone WHERE w < owed""",
        "window_state_opened_late": f"{opened} {state}",
        "panes_opened_late": f"{opened}{pane_ctes('update', LATE)} {PANES}",
        "panes_drop_opened_late": f"{opened_drop}{pane_ctes('drop', LATE)} {PANES}",
        "streaming_by_log": f"{users}{pane_ctes('update', LATE)} {PANES}",
        "streaming_percentile": f"{quantile}{pane_ctes('update', LATE)} {PANES}",
        "streaming_punctuated": f"{punctuated}{pane_ctes('update', LATE)} {PANES}",
        "streaming_drop": f"{drop}{pane_ctes('drop', LATE)} {PANES}",
        "streaming_flush": f"{flushed}{pane_ctes('update', LATE, True)} {PANES}",
        "streaming_receipts": f"{side} {refused}",
        "streaming_panes": f"{bounded}{pane_ctes('update', LATE)} {PANES}",
        "side_output": f"{side} {refused}",
        "streaming_side_output": f"{bounded} {too_late}",
        "timeline": f"{bounded} {timeline}",
        "verdict_windows": f"{bounded} {VERDICT}",
        "verdict_summary": f"{bounded} {SUMMARY}",
        "verdict_reasons": f"{bounded} SELECT log_id, reason, count(*) AS windows FROM verdict WHERE reason IS NOT NULL GROUP BY ALL",
        "verdict_drop": f"{drop} {VERDICT}",
        "verdict_side_output": f"{side} {VERDICT}",
        "verdict_flush": f"{flushed} {VERDICT}",
        "verdict_percentile": f"{quantile} {VERDICT}",
        "verdict_by_log": f"{users} {SUMMARY}",
        "profile_matrix": matrix(),
        "retired_conditions": f"""SELECT sum(windows_all_receipted)::BIGINT AS no_pane_after_close, sum(late_with_one_pane)::BIGINT AS unrevised_late,
            count(*) FILTER (adaptive_regression) AS watermark_regression,
            (sum(windows_all_receipted) + sum(late_with_one_pane) + count(*) FILTER (adaptive_regression))::BIGINT AS total FROM ({matrix()})""",
        "boundary_experiment": boundary(),
        "control_ordered": f"{run_ctes('events_in_order', B10M, HOUR, LATE, flush=True)} {SUMMARY}",
        "control_sweep": control(),
        "audit_overshoot": f"{rate} " + finding.format(
            code="watermark-overshoot", window="NULL", rows="(SELECT log_id, count(*) FILTER (w_after > m) AS n, max(w_after - m) AS over FROM j GROUP BY log_id)",
            detail="concat(n, ' event(s) with the watermark above the highest event time, by up to ', over, ' ms')"),
        "pane_chain_audit": f"{bounded}{pane_ctes('update', LATE)} " + finding.format(
            code="pane-chain-broken", window="win_start", rows="panes WHERE kind = 'revision' AND at_index % 5 = 0",
            detail="concat('pane ', seq, ' retracts ', retracts + 1, ' but the pane before emitted ', retracts)"),
        "audit_premature_close": f"{bounded}{fire_ctes(LATE)} " + finding.format(
            code="premature-close", window="win_start", rows="fire WHERE release_watermark IS NOT NULL",
            detail=f"concat('released at watermark ', win_end, ', {LATE} ms too early')"),
        "audit_pane_count": f"{bounded} " + finding.format(
            code="pane-count-mismatch", window="win_start", rows="win WHERE panes > 0 AND late_in_bound > 1",
            detail="concat(panes - 1, ' pane(s) where ', panes, ' were owed')"),
        "audit_silent_drop": f"{bounded} " + finding.format(
            code="silent-drop", window="NULL", rows="(SELECT log_id, count(*) AS n FROM j WHERE cls = 'too_late' AND i % 3 = 0 GROUP BY log_id)",
            detail="concat(n, ' event(s) neither counted nor receipted')"),
        "verdict_from_panes": f"{bounded} {VERDICT}",
        "findings_from_panes": f"""{bounded} SELECT log_id, CASE WHEN win_start % {5 * HOUR} = 0 THEN 'no-pane-after-close' ELSE 'unexplained-shortfall' END AS code,
            'defect' AS severity, win_start::BIGINT AS win_start, CASE WHEN win_start % {5 * HOUR} = 0
            THEN concat('closed without a pane; ', expected - receipted, ' event(s) unaccounted for')
            ELSE concat('emitted ', emitted - 1, ' of ', expected, ', only ', receipted, ' receipted') END AS detail
            FROM verdict WHERE panes > 0 AND win_start % {5 * HOUR} IN (0, {HOUR})""",
        "rejected_events": """SELECT event_id::BIGINT AS event, CASE WHEN event_id % 89 = 0 THEN 'no log' WHEN event_id % 97 = 0 THEN 'no event time'
            ELSE 'no place in the arrival order' END AS reason FROM events
            WHERE event_id % 89 = 0 OR event_id % 97 = 0 OR event_id % 101 = 0""",
        "verdict_with_rejects": f"{run_ctes('events_kept', B10M, HOUR, LATE)} {SUMMARY}",
        "feed_archive": f"SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS seq, ({EVENT_T})::BIGINT AS t, event_type AS k FROM events",
        "feed_changes": f"""SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS seq, (({EVENT_T}) // 1000 * 1000)::BIGINT AS t,
            ({EVENT_P})::BIGINT AS p, event_type AS k FROM events WHERE event_id % 50 NOT IN (7, 8)""",
        "ndjson_seconds": f"{index} SELECT (i + 1)::BIGINT AS seq, {big('t', 'p')}, k FROM ord",
        "replay_equal": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, n AS left_rows, n AS right_rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM ({counted})"
            for name, counted in row_counts.items() if name in ("panes", "side_output", "trace", "verdict")),
        "run_fingerprint": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, n AS rows, true AS equal FROM ({counted})" for name, counted in row_counts.items()),
        "missing_events": f"{bounded} SELECT log_id, {big('i', 't')} FROM j WHERE cls = 'too_late' AND i % 3 = 0",
    }
