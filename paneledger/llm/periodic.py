"""Periodic runs of words: stretches that repeat one period four times or more.

Seed and extend along diagonals. Two equal words at a distance q lie on the diagonal of
lag q, and a run of period q is a stretch of it: a run of length L has L - q equal pairs
in a row, 3 q of them at least, or 5 for q = 1. The k-grams of that guaranteed length
are the seeds. Lags are taken in classes that double (1, 2 to 3, 4 to 7, ...), each with
the k of its smallest lag; k is no less than any lag of the class, so a k-gram inside a
run comes again after exactly one period and not before. It is therefore enough to pair
every occurrence with the next one of the same text: n pairs a class, not all pairs. A
pair whose lag belongs to the class is extended word by word to both sides, unless the
table of the furthest word covered on its lag says that an earlier seed has been there.
For the same reason the lag of a seed is the smallest period of its run, and the
stretches extended within a class overlap by a bounded factor: n log n in all.

The k-grams are named exactly, by pairs of the names of shorter ones, without hashes;
those that occur once in their text are out of all longer classes. Many texts are
handled at once, with words numbered anew in each, so that no gram is in two texts.
Texts stay where they are: nothing is shuffled, and memory follows the longest text.

Cases: words are ``[^\\x20\\x09-\\x0D]+``, as they are; a null or empty text, or one
without words, has no words and no runs, and collapses to an empty text; repeated rows
are rows like any other; columns with clashing names are carried or replaced as
stated at each function; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from paneledger.llm.text import texts_of

LEAST_WORDS, LEAST_TURNS = 6, 4
# Texts are handled together up to so many words; a longer text is alone.
WORDS_AT_ONCE = 400_000

RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def runs_of(docs: DataFrame, *carried: str) -> DataFrame:
    """The ``carried`` columns, ``n_words``, ``runs`` by start, then period, and
    ``collapsed``: the words outside runs and the first period of each run."""
    own = {"n_words", "runs", "collapsed"}
    if clash := own & {c.lower() for c in carried}:
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    schema = StructType([docs.schema[c] for c in carried]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for words, found in _by_blocks(texts_of(batch)):
                rows = batch.slice(first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in carried], pa.array(list(map(len, words)), pa.int64()),
                     _lists(found), pa.array(map(collapse, words, found), pa.string())],
                    [*carried, "n_words", "runs", "collapsed"])
                first += len(words)

    columns = dict.fromkeys([*carried, "text"])
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that have runs replaced by their collapsed form; other texts,
    and all other columns, stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            texts = list(given)
            first = 0
            for words, found in _by_blocks([text or "" for text in given]):
                for at, (own, runs) in enumerate(zip(words, found)):
                    if len(runs):
                        texts[first + at] = collapse(own, runs)
                first += len(words)
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if k == at else column for k, column in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _by_blocks(texts: list[str]) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """For blocks of texts: the words of each, and its runs, one (start, length, period) a row."""
    block, held = [], 0
    for at, text in enumerate(texts):
        block.append(text.encode().split())
        held += len(block[-1])
        if held >= WORDS_AT_ONCE or at == len(texts) - 1:
            yield block, _runs_of_texts(block)
            block, held = [], 0


def _runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    codes, given = np.empty(starts[-1], np.int64), 0
    for words, start in zip(texts, starts):
        numbers: dict[bytes, int] = {}
        codes[start:start + len(words)] = [numbers.setdefault(word, given + len(numbers)) for word in words]
        given += len(numbers)
    found = runs(codes)
    own = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[own]
    return np.split(found, np.searchsorted(own, np.arange(1, len(texts))))


def runs(codes: np.ndarray) -> np.ndarray:
    """All runs of a sequence of codes, one (start, length, period) a row, by start, then period."""
    found = []
    for k, least, most, seeds, lags in _seeds(codes):
        for lag in np.unique(lags):
            found += _extended(codes, seeds[lags == lag], int(lag), k)
    found = np.array(found, np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _seeds(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """For each class of lags: its k, its least and most lag, the ascending positions of
    k-grams that come again after such a lag, and these lags."""
    twos = _named(codes, np.arange(len(codes)), 1, codes)
    threes = _named(twos, np.flatnonzero(twos >= 0), 2, codes)
    yield 5, 1, 1, *_next_again(_named(threes, np.flatnonzero(threes >= 0), 3, twos), 1, 1)
    names, length, least = threes, 3, 2
    while len(at := np.flatnonzero(names >= 0)):
        names, length = _named(names, at, length, names), 2 * length
        yield length, least, 2 * least - 1, *_next_again(names, least, 2 * least - 1)
        least *= 2


def _named(names: np.ndarray, at: np.ndarray, shift: int, tails: np.ndarray) -> np.ndarray:
    """Names of the longer grams that begin ``at`` these positions: the pair of the name
    there and the one of the tail ``shift`` words on; -1 where a gram is the only one."""
    longer = np.full(len(names), -1, np.int64)
    at = at[at + shift < len(names)]
    at = at[tails[at + shift] >= 0]
    if not len(at):
        return longer
    pairs = names[at] * (tails.max() + 1) + tails[at + shift]
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    longer[at[order[several]]] = group[several]
    return longer


def _next_again(names: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(names >= 0)
    order = at[np.argsort(names[at], kind="stable")]
    lags = order[1:] - order[:-1]
    seed = (names[order[1:]] == names[order[:-1]]) & (lags >= least) & (lags <= most)
    seeds, lags = order[:-1][seed], lags[seed]
    order = np.argsort(seeds)
    return seeds[order], lags[order]


def _extended(codes: np.ndarray, seeds: np.ndarray, lag: int, k: int) -> list[tuple[int, int, int]]:
    """The runs on one lag. ``covered`` is the first word that no extension on this lag
    has reached: seeds before it lie on a stretch that has been extended already."""
    found, at = [], 0
    while at < len(seeds):
        seed = int(seeds[at])
        start, covered = _equal_before(codes, seed, lag), _equal_from(codes, seed + k, lag)
        length = covered - start + lag
        if length >= max(LEAST_WORDS, LEAST_TURNS * lag):
            found.append((start, length, lag))
        at = int(np.searchsorted(seeds, covered))
    return found


def _equal_from(codes: np.ndarray, at: int, lag: int) -> int:
    """The first position from ``at`` on whose word differs from that ``lag`` words on."""
    end, step = len(codes) - lag, 64
    while at < end:
        differ = codes[at:min(at + step, end)] != codes[at + lag:min(at + step, end) + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), 2 * step
    return end


def _equal_before(codes: np.ndarray, at: int, lag: int) -> int:
    """The first position of the equal words that end before ``at``."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        differ = codes[low:at] != codes[low + lag:at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = low, 2 * step
    return 0


def collapse(words: list[bytes], found: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[at] for at in np.flatnonzero(np.cumsum(change[:-1]) == 0)]).decode()


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
    fields = [pa.array(rows[:, k]) for k in range(3)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
