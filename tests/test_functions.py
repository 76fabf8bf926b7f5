from __future__ import annotations

import pytest

from paneledger import Config, WatermarkSpec
from paneledger.functions import human_ms, parse_window_key, watermark_text, window_end, window_key, window_start
from paneledger.names import END_OF_STREAM
from paneledger.operators.truth import batch_windows, lateness_profile
from paneledger.operators.arrival import index_log


def values(spark, sql, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x bigint")
    return [r.y for r in rows.selectExpr("i", f"{sql} AS y").orderBy("i").collect()]


def test_window_start_floors(spark):
    assert values(spark, window_start("x", 1000), [0, 999, 1000, -1, -1000, -1001]) == [0, 0, 1000, -1000, -1000, -2000]
    assert values(spark, window_start("x", 1000, 250), [0, 250, 1249]) == [-750, 250, 250]
    with pytest.raises(ValueError, match="positive integer"):
        window_start("x", 0)


def test_window_keys(spark):
    start = window_start("x", 60_000)
    key = window_key(start, window_end(start, 60_000))
    assert values(spark, key, [-1, 5]) == ["-60000-0", "0-60000"]
    assert [tuple(w) for w in values(spark, parse_window_key(f"({key})"), [-1])] == [(-60000, 0)]
    with pytest.raises(Exception, match="not a window key"):
        values(spark, parse_window_key("'12-'"), [1])


def test_human_ms_rounds_like_the_nearest_double(spark):
    cases = {0: "0ms", -999: "-999ms", 1450: "1.4s", 1550: "1.6s", 1250: "1.3s", -1500: "-1.5s", 59_999: "60.0s",
             90_000: "1.5m", 3_600_000: "1.0h", 86_400_000 * 3: "3.0d", 1350: "1.4s", 8350: "8.3s"}
    assert values(spark, human_ms("x"), list(cases)) == list(cases.values())


def test_watermark_text(spark):
    assert values(spark, watermark_text("x"), [None, END_OF_STREAM, 5]) == ["-inf (never advanced)", "+inf (end of stream)", "5"]


def test_batch_windows_ignore_order(make_log):
    for times in ([0, 1000, 2000, 5000], [5000, 0, 2000, 1000]):
        assert {r.win_start: r["count"] for r in batch_windows(make_log(times), 4000).collect()} == {0: 3, 4000: 1}


def test_lateness_profile(make_log):
    def profile(times, blocks=None):
        return lateness_profile(index_log(make_log(times), ["seq"]).rows, blocks).first()

    assert (profile([0, 5000, 1000, 6000]).out_of_order, profile([0, 5000, 1000, 6000]).max_lateness) == (1, 4000)
    assert profile([100, 100, 100]).out_of_order == 0
    times = [(i * 37) % 101 * 10 for i in range(300)]
    seen, lats = -1, []
    for t in times:
        lats.append(max(0, seen - t))
        seen = max(seen, t)
    lats.sort()
    row = profile(times, 5)
    assert [row.p50, row.p90, row.p99, row.p999] == [lats[min(299, int(p * 300))] for p in (0.5, 0.9, 0.99, 0.999)]


@pytest.mark.parametrize("change, message", [
    ({"window_ms": 0}, "positive integer"), ({"window_ms": -5}, "positive integer"), ({"window_ms": 1.5}, "integer"),
    ({"allowed_lateness_ms": -1}, "zero or more"), ({"late_policy": "keep"}, "known: drop, update, side-output"),
    ({"termination": "stop"}, "known: idle, flush"),
])
def test_config_is_checked(change, message):
    with pytest.raises(ValueError, match=message):
        Config(**change)


def test_strategy_is_checked():
    with pytest.raises(ValueError, match="known: bounded, bounded-naive, percentile, punctuated, processing-time"):
        WatermarkSpec("guess")
    with pytest.raises(ValueError, match="between 0 and 1"):
        WatermarkSpec("percentile", percentile=1.5)


def test_lenient_config_falls_back_and_clamps():
    config = Config.lenient({"window": "-3", "lateness": "x", "policy": "keep", "bound": 2.6, "watermark": "punctuated"})
    assert (config.window_ms, config.allowed_lateness_ms, config.late_policy) == (1, 6_000, "update")
    assert (config.watermark.name, config.watermark.bound_ms) == ("punctuated", 3)
