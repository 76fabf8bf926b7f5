"""A one-event-at-a-time model of a run, used only to check the Spark tables."""

from __future__ import annotations

from collections import deque

from paneledger.config import Config

INF = float("inf")
END = 9223372036854775807


def raw_watermarks(times: list[int], spec) -> list[float]:
    out, seen, lats, origin = [], -INF, deque(maxlen=spec.sample_size), spec.origin_ms
    low, mark = INF, -INF
    for i, t in enumerate(times):
        if i:
            lats.append(max(0, seen - t))
        seen = max(seen, t)
        low = min(low, t)
        if origin is None:
            origin = t
        if (i + 1) % spec.every_n == 0:
            mark, low = low - 1, INF
        bound = spec.floor_ms
        if spec.name == "percentile" and lats:
            bound = max(bound, sorted(lats)[min(len(lats) - 1, int(spec.percentile * len(lats)))])
        out.append({
            "bounded": seen - spec.bound_ms - 1, "bounded-naive": seen - spec.bound_ms,
            "percentile": seen - bound - 1, "punctuated": mark,
            "processing-time": origin + i * spec.ms_per_event,
        }[spec.name])
    return out


def db(w: float) -> int | None:
    return None if w == -INF else END if w == INF else w


def run_model(times: list[int], config: Config) -> dict:
    size, off, bound, policy = config.window_ms, config.offset_ms, config.allowed_lateness_ms, config.late_policy
    windows, panes, side, trace = {}, [], [], []
    w, seen = -INF, -INF
    health = {"watermark_overshoots": 0, "watermark_regressions": 0, "max_overshoot_ms": 0, "max_regression_ms": 0}

    def emit(win, i):
        panes.append({
            "win_start": win["start"], "seq": win["panes"] + 1, "kind": "initial" if not win["panes"] else "revision",
            "count": win["count"], "retracts": win["emitted"] if win["panes"] else None, "watermark": db(w), "at_index": i,
        })
        win["panes"] += 1
        win["emitted"] = win["count"]

    def advance(i):
        for win in windows.values():
            if not win["panes"] and w >= win["end"]:
                win["fired_at"] = db(w)
                emit(win, i)
        for win in windows.values():
            if win["panes"] and win["collected_at"] is None and w >= win["end"] + bound:
                win["collected_at"] = db(w)

    for i, (t, raw) in enumerate(zip(times, raw_watermarks(times, config.watermark))):
        seen = max(seen, t)
        start = (t - off) // size * size + off
        end = start + size
        late, gone = w >= end, w >= end + bound
        if late and gone:
            side.append({"index": i, "t": t, "win_start": start, "lateness_ms": w - end})
        else:
            win = windows.setdefault(start, {
                "start": start, "end": end, "count": 0, "panes": 0, "emitted": None, "on_time": 0, "late": 0,
                "opened_late": False, "fired_at": None, "collected_at": None})
            if not late:
                win["count"] += 1
                win["on_time"] += 1
            else:
                win["late"] += 1
                if policy == "update":
                    win["count"] += 1
                    if not win["panes"]:
                        win["opened_late"], win["fired_at"] = True, w
                    emit(win, i)
                elif policy == "side-output":
                    side.append({"index": i, "t": t, "win_start": start, "lateness_ms": w - end})
        if raw > w:
            w = raw
            trace.append({"index": i, "watermark": db(w)})
        elif raw < w and raw != -INF:
            health["watermark_regressions"] += 1
            health["max_regression_ms"] = max(health["max_regression_ms"], w - raw)
        if w > seen:
            health["watermark_overshoots"] += 1
            health["max_overshoot_ms"] = max(health["max_overshoot_ms"], w - seen)
        advance(i)
    if config.termination == "flush":
        w = INF
        trace.append({"index": len(times), "watermark": END})
        advance(len(times))

    truth: dict[int, int] = {}
    for t in times:
        start = (t - off) // size * size + off
        truth[start] = truth.get(start, 0) + 1
    verdict = {}
    for start, expected in truth.items():
        win = windows.get(start, {"panes": 0, "emitted": None, "late": 0})
        discarded = 0 if policy == "update" else win["late"]
        too_late = sum(1 for s in side if s["win_start"] == start and s["lateness_ms"] >= bound)
        receipted = discarded + too_late
        if not win["panes"]:
            outcome = ("unverifiable", "watermark-never-reached") if w < start + size else (
                ("unverifiable", "lateness-bound-exceeded") if receipted >= expected else ("unverifiable", "no-pane-after-close"))
        elif win["emitted"] == expected:
            outcome = ("revised", None) if win["panes"] > 1 else ("complete", None)
        elif expected - win["emitted"] == receipted > 0:
            outcome = ("unverifiable", "policy-discard" if discarded else "lateness-bound-exceeded")
        else:
            outcome = ("unverifiable", "unexplained-shortfall")
        verdict[start] = outcome
    return {"windows": windows, "panes": panes, "side": side, "trace": trace, "verdict": verdict, "health": health, "final": db(w)}
