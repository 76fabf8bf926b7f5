"""Quality rules: base counts of a text and gradient-boosted trees over its statistics.

The trees are grown on at most ``sample`` labelled documents (those whose id has the
smallest hash), by Newton steps of the logistic loss on quantile bins. A feature may
be constrained to be monotonic: a split that would run against it is not taken, and
the values below a taken split stay on their side of the middle. The trees are kept
flat in numpy arrays and all of them walk down one level at a time for a whole batch.

Cases: a null or empty text has no words, so it fails the base rules; without any
labelled document, or with one class only, the trees say nothing and the base rules
decide; labels with null ids or null qualities are not used; null or repeated ids
keep one row each; other columns are carried through ``keep_good`` untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.llm.text import batches_of, sampled, texts_of

SAMPLE = 8_000
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_SPACE = "".join(SPACES)
SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistic -> -1 where more of it must never make a text better, 0 where free.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "repeated_lines": -1, "repeated_words": -1,
    "upper": -1, "exclamations": -1, "doubled_words": -1, "variety": 0, "ends": 0, "digits": -1, "line_length": 0,
}


def base_counts(text: str, words: list[bytes]) -> tuple[int, ...]:
    """The five counts of BASE."""
    word_chars = len(text) - sum(map(text.count, SPACES)) if words else 0
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def features(text: str, words: list[bytes], base: tuple[int, ...]) -> list[float]:
    n_words, word_chars, symbols, dup_lines, repeated = base
    if not n_words:
        return [0.0] * len(FEATURES)
    data = text.encode()
    lines = text.count("\n") + 1
    upper = len(data) - len(data.translate(None, UPPER))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    return [
        math.log1p(n_words), word_chars / n_words, symbols / word_chars, dup_lines / lines, repeated / n_words,
        upper / word_chars, text.count("!") / n_words, sum(map(eq, words, words[1:])) / n_words,
        len(set(words)) / n_words, (text.count(".") + text.count("?")) / n_words, digits / word_chars,
        n_words / lines,
    ]


def described(text: str) -> tuple[tuple[int, ...], list[float]]:
    words = text.encode().split()
    base = base_counts(text, words)
    return base, features(text, words, base)


def base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


@dataclass
class Trees:
    """Trees of one depth in flat arrays, a row per tree: node ``k`` has the children
    ``2k + 1`` and ``2k + 2``; ``leaf`` has the values of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability that a text is good, for each row of ``x``."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while node[0, 0] < inner if len(node) else False:
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.start + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3,
         rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees; ``least`` is the smallest sum of second derivatives in a leaf."""
    inner = 2 ** depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 10.0)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(cuts, x.T)])
    start = math.log(y.mean() / (1 - y.mean()))
    total = np.full(len(y), start)
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        where = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for node in range(inner):
            own = where == node
            best = _split(binned[:, own], slope[own], bend[own], cuts, monotone, low[node], high[node], penalty, least)
            left, right = 2 * node + 1, 2 * node + 2
            low[left] = low[right] = low[node]
            high[left] = high[right] = high[node]
            if best is None:  # everything goes left
                where[own] = left
                continue
            at, bin_, middle = best
            feature[tree, node], threshold[tree, node] = at, cuts[at][bin_]
            if monotone[at] > 0:
                high[left] = low[right] = middle
            elif monotone[at] < 0:
                low[left] = high[right] = middle
            where[own] = np.where(binned[at, own] > bin_, right, left)
        for k in range(inner + 1):
            own = where == inner + k
            value = slope[own].sum() / (bend[own].sum() + penalty)
            leaf[tree, k] = rate * min(max(value, low[inner + k]), high[inner + k])
        total += leaf[tree, where - inner]
    return Trees(feature, threshold, leaf, start)


def _split(binned, slope, bend, cuts, monotone, low, high, penalty, least):
    best, best_gain = None, 1e-6
    if len(slope) == 0:
        return None
    all_slope, all_bend = slope.sum(), bend.sum()
    for at, cut in enumerate(cuts):
        if not len(cut):
            continue
        g = np.bincount(binned[at], slope, len(cut) + 1).cumsum()[:-1]
        h = np.bincount(binned[at], bend, len(cut) + 1).cumsum()[:-1]
        left = np.clip(g / (h + penalty), low, high)
        right = np.clip((all_slope - g) / (all_bend - h + penalty), low, high)
        gain = g ** 2 / (h + penalty) + (all_slope - g) ** 2 / (all_bend - h + penalty) - all_slope ** 2 / (all_bend + penalty)
        fits = (h >= least) & (all_bend - h >= least) & (monotone[at] * (right - left) >= 0)
        gain = np.where(fits, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best_gain:
            best, best_gain = (at, k, (left[k] + right[k]) / 2), gain[k]
    return best


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and qualities of at most ``sample`` labelled documents."""
    batches_of(docs.sparkSession)
    usable = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    chosen = sampled(usable, ["doc_id", "quality"], sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([described(text)[1] for text in texts_of(batch)], pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"])

    described_rows = rows.mapInArrow(describe, "doc_id long, quality int, x array<double>")
    found = described_rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).collect()
    return np.array([row.x for row in found]).reshape(-1, len(FEATURES)), np.array([float(row.quality > 0) for row in found])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    return grow(*training_rows(docs, labels, sample), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id``, the counts of BASE, ``base_failed``, ``score`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = "doc_id long, " + ", ".join(f"{name} long" for name in BASE) + ", base_failed boolean, score double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, score = _judged(texts_of(batch), shared.value)
            columns = [batch.column("doc_id"), *(pa.array(column, pa.int64()) for column in zip(*base)), pa.array(failed),
                       pa.array(score), pa.array(~failed & (score >= 0.5))]
            if base:
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _judged(texts: list[str], trees: Trees) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    found = [described(text) for text in texts]
    x = np.array([row for _, row in found]).reshape(-1, len(FEATURES))
    return [base for base, _ in found], np.array([base_failed(base) for base, _ in found], bool), trees.score(x)


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the trees, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(at).to_pylist()]
            _, failed, score = _judged(texts, shared.value)
            yield batch.filter(pa.array(~failed & (score >= 0.5)))

    return docs.mapInArrow(run, docs.schema)
