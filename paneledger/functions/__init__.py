from paneledger.functions.text import human_ms, lateness_text, watermark_text
from paneledger.functions.times import epoch_ms, iso_ms, seconds_ms
from paneledger.functions.windows import parse_window_key, window_end, window_key, window_start

__all__ = [
    "epoch_ms", "human_ms", "iso_ms", "lateness_text", "parse_window_key", "seconds_ms", "watermark_text",
    "window_end", "window_key", "window_start",
]
