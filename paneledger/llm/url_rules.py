"""URL filters: rules first, then a classifier over segmented names.

A rule is a host and the start of a path. It fits its host and all subdomains; of the
rules that fit the longest counts. Urls without a rule are judged by multinomial
naive Bayes over the words of host and path, which learns from all urls that a rule
judges. Host names are split into words by a unigram model (Viterbi): the words are
the most frequent ones of the pages, what is not among them costs ten times more
with each letter.

Rules are a table and joined by the suffixes of the host, so they may be many. The
unigrams are at most VOCABULARY, the classifier counts words by hash in BUCKETS
classes of words; both are broadcast. Both are counted over all pages.

Cases: a null url, or one without ``://``, has an empty host and path, which no rule
fits; without urls under rules, and at equal scores, the verdict is allow; of equally
long rules the last in order counts; a null html teaches no words; repeated rows and
ids keep a row each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.llm.hashing import words_of
from paneledger.llm.text import frequent, numbered
from paneledger.workspace import keep

VOCABULARY, LONGEST_WORD = 100_000, 24
BUCKETS = 1 << 16
CACHED_HOSTS = 200_000
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123)]] = False
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(row_key, page_id, host, path, rule, verdict)`` of every page; ``rules`` are
    (host, path, verdict), rule and verdict are null where none fits."""
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    parts = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)[^?#]*", 1), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    urls = numbered(pages, "page_id", "url").select(
        "row_key", "page_id", F.coalesce(F.translate(parts[0], _UPPER, _LOWER), F.lit("")).alias("host"), F.coalesce(parts[1], F.lit("")).alias("path"))
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda at: F.array_join(F.slice(names, at, F.size(names)), "."))
    fitting = urls.withColumn("suffix", F.explode(suffixes)).join(
        table, (F.col("suffix") == F.col("rule_host")) & F.startswith(F.col("path"), F.col("rule_path")), "left")
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "verdict"), F.when(F.col("verdict").isNotNull(), F.struct(F.length(rule), rule)))
    return fitting.groupBy("row_key", "page_id", "host", "path").agg(best.alias("best")).select("row_key", "page_id", "host", "path", "best.rule", "best.verdict")


def page_words(pages: DataFrame) -> DataFrame:
    """``(piece, n)``: the lower-cased runs of letters a-z in the pages' html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("html"), 4 << 20, _NOT_LETTER):
                lengths = words.ends - words.starts
                fits = (lengths > 1) & (lengths <= LONGEST_WORD)
                _, first, n = np.unique(words.hashes()[fits], return_index=True, return_counts=True)
                data, starts, ends = words.data.tobytes(), words.starts[fits][first].tolist(), words.ends[fits][first].tolist()
                pieces = [data[start:end].lower() for start, end in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(n)], ["piece", "n"])

    return pages.select("html").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


@dataclass
class Segmenter:
    """Splits names into words by the likeliest sequence of unigrams."""

    counts: dict[str, int]
    _known: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = max(1, sum(self.counts.values()))

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return math.log(self.total / n) if n else math.log(self.total) + (len(word) - 1) * math.log(10)

    def split(self, name: str) -> list[str]:
        """The cheapest split of a run of letters; of equally cheap ones, the one with
        the longest last word."""
        best, last = [0.0], [0]
        for end in range(1, len(name) + 1):
            costs = [(best[start] + self.cost(name[start:end]), start) for start in range(max(0, end - LONGEST_WORD), end)]
            value, start = min(costs)
            best.append(value)
            last.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[last[end]:end])
            end = last[end]
        return words[::-1]

    def host_words(self, host: str) -> list[str]:
        """The words of a host, its last label marked as such; numbers by their length."""
        found = self._known.get(host)
        if found is None:
            if len(self._known) >= CACHED_HOSTS:
                self._known.clear()
            *labels, top = host.split(".")
            runs = [run for label in labels for run in re.findall(r"[a-z]+|[0-9]+|[^a-z0-9-]+", label)]
            found = [f"h:{word}" for run in runs for word in (self.split(run) if run[0] in _LOWER else [_digits(run)])] + [f"t:{top}"]
            self._known[host] = found
        return found

    def words(self, host: str, path: str) -> list[str]:
        runs = re.findall(r"[^\W\d_]+|[0-9]+", path.lower())
        return self.host_words(host) + [f"p:{_digits(run)}" for run in runs]


def _digits(run: str) -> str:
    return f"#{len(run)}" if run[0].isdigit() else run


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % BUCKETS


def learnt(urls: DataFrame, words: Segmenter) -> np.ndarray:
    """``[bucket]``: what a word adds to the log odds of allow; the last entry is what
    the classes' shares add. From the urls that have a verdict."""
    shared = urls.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[bool, int]] = Counter()
        for batch in batches:
            for host, path, verdict in zip(*(batch.column(name).to_pylist() for name in ("host", "path", "verdict"))):
                allow = verdict == "allow"
                counts.update((allow, bucket(word)) for word in shared.value.words(host, path))
                counts[allow, BUCKETS] += 1
        rows = list(zip(*((allow, at, n) for (allow, at), n in counts.items()))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.bool_()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], ["allow", "bucket", "n"])

    rows = urls.where("verdict IS NOT NULL").select("host", "path", "verdict").mapInArrow(run, "allow boolean, bucket int, n long")
    counts = np.zeros((2, BUCKETS + 1))
    for row in rows.groupBy("allow", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 (BUCKETS + 1) rows
        counts[int(row.allow), row.bucket] = row.n
    odds = np.zeros(BUCKETS + 1)
    shares = np.log(counts[:, :-1] + 1) - np.log(counts[:, :-1].sum(axis=1, keepdims=True) + BUCKETS)
    odds[:-1] = shares[1] - shares[0]
    odds[-1] = np.log(counts[1, -1] + 1) - np.log(counts[0, -1] + 1)
    return odds


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row of ``pages``
    (page_id, url, html); ``score`` is the classifier's log odds of allow."""
    urls = keep(ruled(pages, rules), "urls")
    top = frequent(keep(page_words(pages), "words"), VOCABULARY).collect()
    words = Segmenter({row.piece.decode(): row.n for row in top})
    odds = learnt(urls, words)
    shared = pages.sparkSession.sparkContext.broadcast((words, odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        for batch in batches:
            scores, verdicts = [], []
            for host, path, verdict in zip(*(batch.column(name).to_pylist() for name in ("host", "path", "verdict"))):
                score = float(weight[-1] + sum(weight[bucket(word)] for word in own.words(host, path)))
                scores.append(score)
                verdicts.append(verdict or ("allow" if score >= 0 else "block"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
