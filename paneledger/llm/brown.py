"""Language-model scores from Brown classes.

P(word | word before) = P(class | class before) * P(word | class). Classes come from
exchange clustering: every unit in turn goes to the class that raises the likelihood
of the class bigrams most, given how often each class stands before and after it.
Units are all words seen LEAST times or more, the UNITS most frequent in any case, and
one for each of SUFFIXES groups of the other words, seen or not, that end alike; so any
word has a class. The number of classes grows with the fourth root of the number of
words. Counts are taken over all training text, anew after each round.

The UNITS most frequent words and the groups (the head) are exchanged first, one by one
on the driver, over a table of fixed size; all other words (the tail) follow the group
they end like. Then the tail is exchanged too, in tasks: each word's neighbours are
gathered once, keyed by word, and every round counts their classes anew. Class transitions are smoothed by ALPHA. Within a class a word has
(n + DELTA) / (N + DELTA * (V + 1)), for the class's N tokens and V different words;
the one more is a word not seen.

The end of a text is a token and a class of its own, which also stands before the
first word. Words are told apart by a 64-bit hash of their bytes (A-Z lower-cased).

Word counts grow with the corpus and are never gathered. The MOST_FREQUENT most
frequent, a bounded table, are broadcast and looked up in place; the rest of a
document's words go through a shuffle join by hash, where none is frequent.

Cases: a null or empty text is its end only; without training text every token has
count 0 and every class the same probability; a null id is neither held out nor
learnt from; repeated rows and ids keep a row each; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneledger.llm.hashing import Words, mixed, words_of
from paneledger.llm.text import frequent, numbered
from paneledger.workspace import keep

CLASSES, UNITS, SUFFIXES = 32, 8_192, 1_024  # CLASSES: the least number
LEAST = 3
ROUNDS, TAIL_ROUNDS = 6, 4
MOST_FREQUENT = 200_000
ALPHA, DELTA = 0.5, 0.5
_WORDS_AT_ONCE = 4_000_000
_CELLS_AT_ONCE = 2_000_000
_PARTS_OF_CELLS = 256
_TIMES_AT_HAND = 4
_STEPS = 64
_LOWERED = np.arange(256, dtype=np.uint64)
_LOWERED[65:91] += 32


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def class_number(words: int) -> int:
    return max(CLASSES, int(2 * words ** 0.25))


def suffix_of(words: Words, suffixes: int) -> np.ndarray:
    """The group of every word, from its last three bytes (A-Z lower-cased)."""
    ends = words.ends - 1
    code = _LOWERED[words.data[ends]] if len(ends) else np.zeros(0, np.uint64)
    for back in (1, 2):
        at = ends - back
        code = code << np.uint64(8) | np.where(at >= words.starts, _LOWERED[words.data[np.maximum(at, 0)]], np.uint64(0))
    return (mixed(code) % np.uint64(suffixes)).astype(np.int64)


def word_counts(texts: DataFrame, suffixes: int) -> DataFrame:
    """``(word, suffix, n)`` over all ``texts``, words as hashes; counted in tasks, then
    summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for words in words_of(batch.column("text")):
                held.append((words.hashes(), suffix_of(words, suffixes)))
                n += len(held[-1][0])
                if n > _WORDS_AT_ONCE:
                    yield _counts(held)
                    held, n = [], 0
        yield _counts(held)

    return texts.select("text").mapInArrow(run, "word long, suffix int, n long").groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def _counts(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    hashes, suffixes = map(np.concatenate, zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([_int64(words), pa.array(suffixes[first].astype(np.int32)), _int64(n)], ["word", "suffix", "n"])


@dataclass
class Units:
    """Words -> units: a frequent word's is its place in ``words``, then come the groups
    of words that end alike, the end of a text, and the words of ``tail``."""

    words: np.ndarray
    suffixes: int
    tail: np.ndarray

    @property
    def end(self) -> int:
        return len(self.words) + self.suffixes

    @property
    def size(self) -> int:
        return self.end + 1 + len(self.tail)

    def of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        return self.by_group(hashes, suffix_of(words, self.suffixes))

    def by_group(self, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The units of words, from their hashes and the groups they end like."""
        units = len(self.words) + groups
        rest = np.arange(len(hashes))
        for known, first in ((self.words, 0), (self.tail, self.end + 1)):
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes[rest]), len(known) - 1)
                found = known[place] == hashes[rest]
                units[rest[found]] = first + place[found]
                rest = rest[~found]
        return units


def unit_rows(texts: DataFrame, units: Units) -> DataFrame:
    """``ids``: the units of every text in order, its end included, 4 bytes each."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text")):
                tokens, _ = with_ends(shared.value.of(words, words.hashes()), words.offsets, shared.value.end)
                offsets = 4 * (words.offsets + np.arange(len(words.offsets))).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(tokens.astype("<i4"))])
                yield pa.RecordBatch.from_arrays([ids], ["ids"])

    return texts.select("text").mapInArrow(run, "ids binary")


def with_ends(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token of the texts, ends included, and the one before it (the end before
    the first)."""
    tokens = np.insert(ids, offsets[1:], end)
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], end
    return tokens, before


def _int32(column: pa.Array) -> np.ndarray:
    """The numbers of a binary column, all rows in a row."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.int32)
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<i4")


def tokens_of(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token, and the one before it: before a text stands the end of another."""
    tokens = _int32(batch.column("ids"))
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], end
    return tokens, before


def neighbours(ids: DataFrame, end: int, rows: np.ndarray, classes: np.ndarray, n_rows: int, n_classes: int) -> np.ndarray:
    """``[0, r, c]``: how often class ``c`` stands before a unit of row ``r``; ``[1, r, c]``:
    after it. Counted in tasks and summed by parts of the table, which does not grow with
    the words: a task hands on one byte a cell, and what is above it for the few large ones."""
    shape = (2, n_rows, n_classes)
    n_cells = 2 * n_rows * n_classes
    rims = np.linspace(0, n_cells, _PARTS_OF_CELLS + 1).astype(np.int64)
    shared = ids.sparkSession.sparkContext.broadcast((rows.astype(np.int32), classes.astype(np.int16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, of = shared.value
        half = shape[1] * shape[2]
        cells = np.zeros(2 * half, np.int64)
        line = row_of * np.int64(n_classes)
        for batch in batches:
            tokens, _ = tokens_of(batch, end)
            for first in range(0, len(tokens), _WORDS_AT_ONCE):
                # The token before the first is the end of a text, or the last one done.
                some = tokens[max(0, first - 1):first + _WORDS_AT_ONCE]
                some = some if first else np.concatenate([[end], some])
                at, c = line[some], of[some]
                cells[:half] += np.bincount(at[1:] + c[:-1], minlength=half)
                cells[half:] += np.bincount(at[:-1] + c[1:], minlength=half)
        low, large = cells.astype(np.uint8), np.flatnonzero(cells >= 256)
        bounds = np.searchsorted(large, rims)
        at, above = (large - np.repeat(rims[:-1], np.diff(bounds))).astype("<i4"), (cells[large] >> 8).astype("<i8")
        columns = [low[a:b].tobytes() for a, b in zip(rims, rims[1:])], *(
            [column[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] for column in (at, above))
        some = pa.array(np.arange(_PARTS_OF_CELLS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([some, *(pa.array(column, pa.binary()) for column in columns)], ["part", "low", "at", "above"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, low, at, above in zip(*(column.to_pylist() for column in batch.columns)):
                own = sums.setdefault(part, np.zeros(len(low), np.int64))
                own += np.frombuffer(low, np.uint8)
                own[np.frombuffer(at, "<i4")] += np.frombuffer(above, "<i8") << 8
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([own.astype("<i8").tobytes() for own in sums.values()], pa.binary())], ["part", "n"])

    found = ids.mapInArrow(run, "part int, low binary, at binary, above binary").repartition(F.col("part")).mapInArrow(
        summed, "part int, n binary").toArrow()
    shared.destroy()
    cells = np.zeros(n_cells)
    for part, n in zip(found["part"].to_pylist(), found["n"].to_pylist()):
        cells[rims[part]:rims[part + 1]] = np.frombuffer(n, "<i8")
    return cells.reshape(shape)


def near_tail(ids: DataFrame, units: Units) -> DataFrame:
    """``(units, sizes, near)`` of the tail's words: the units before them, and those after
    them plus ``units.size``, as many as ``sizes`` say for each. What several tasks found of
    a word is together in one partition, and in order."""
    end, size = units.end, units.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            tokens, before = tokens_of(batch, end)
            for own, near in ((tokens, before), (before, tokens + np.int32(size))):
                some = own > end
                held.append((own[some], near[some]))
                n += len(held[-1][0])
            if n > _WORDS_AT_ONCE:
                yield _lists(held)
                held, n = [], 0
        yield _lists(held)

    return ids.mapInArrow(run, "unit int, near binary").repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(
        _packed, "units binary, sizes binary, near binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many rows (unit, near) as one, still in order: every round reads few of them."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("near"))) // 4)
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + _CELLS_AT_ONCE // 2, "right")))
            rows = batch.slice(first, last - first)
            columns = np.asarray(rows.column("unit")), np.diff(sizes[first:last], prepend=before).astype("<i4"), _int32(rows.column("near"))
            yield pa.RecordBatch.from_arrays([pa.array([column.astype("<i4").tobytes()], pa.binary()) for column in columns], ["units", "sizes", "near"])
            first = last


def _lists(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    own, near = map(np.concatenate, zip(*held)) if held else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    order = np.argsort(own, kind="stable")
    units, starts = np.unique(own[order], return_index=True)
    offsets = (4 * np.append(starts, len(own))).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer(near[order].astype("<i4"))])
    return pa.RecordBatch.from_arrays([pa.array(units), lists], ["unit", "near"])


def tail_moves(near: DataFrame, units: Units, classes: np.ndarray, bigrams: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the tail that move this round, every second one, and their classes."""
    size = units.size
    shared = near.sparkSession.sparkContext.broadcast((classes.astype(np.int16), bigrams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = shared.value
        n, width = n.copy(), len(n)
        for unit, entries in _words_of_tail(batches, turn):
            new = np.concatenate([[True], unit[1:] != unit[:-1]])
            starts, after = np.append(np.flatnonzero(new), len(unit)), entries >= size
            own = of[unit[starts[:-1]]].astype(np.int64)
            key = ((np.cumsum(new) - 1) * 2 + after) * width + of[entries - size * after]
            to = own.copy()
            # Some words at a time; counts follow this task's own moves.
            cuts = np.linspace(0, len(own), min(_STEPS, len(own)) + 1).astype(np.int64)
            for first, last in zip(cuts, cuts[1:]):
                part = key[starts[first]:starts[last]] - first * 2 * width
                best, gain = best_classes(part, own[first:last], n, _at_hand(n))
                moved = gain > 1e-9
                beside = np.bincount(part, minlength=(last - first) * 2 * width).reshape(-1, 2, width)[moved]
                for table, side in ((n, 1), (n.T, 0)):
                    np.subtract.at(table, own[first:last][moved], beside[:, side])
                    np.add.at(table, best[moved], beside[:, side])
                np.maximum(n, 0, out=n)
                to[first:last][moved] = best[moved]
            moved = to != own
            yield pa.RecordBatch.from_arrays([pa.array(unit[starts[:-1]][moved].astype(np.int32)), pa.array(to[moved].astype(np.int32))], ["unit", "class"])

    moves = near.mapInArrow(run, "unit int, class int").toArrow()
    shared.destroy()
    return moves["unit"].to_numpy(), moves["class"].to_numpy()


def _words_of_tail(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole words: the unit of every entry, and the entry."""
    held, n = [], 0
    for batch in batches:
        unit = np.repeat(_int32(batch.column("units")), _int32(batch.column("sizes")))
        some = unit % 2 == turn % 2
        held.append((unit[some], _int32(batch.column("near"))[some]))
        n += int(some.sum())
        if n > _CELLS_AT_ONCE // 8:
            unit, near = map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(unit, unit[-1]))  # the last word may go on
            if cut:
                yield unit[:cut], near[:cut]
            held, n = [(unit[cut:], near[cut:])], len(unit) - cut
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _at_hand(n: np.ndarray) -> np.ndarray:
    """``[0, k, d, c]``: what k more of class ``d`` after class ``c`` add; ``[1, ...]``:
    before it. Nothing for a class and itself, which are counted apart."""
    more = np.arange(_TIMES_AT_HAND)[:, None, None]
    table = np.stack([_f(n.T + more) - _f(n.T), _f(n + more) - _f(n)])
    table[..., np.arange(len(n)), np.arange(len(n))] = 0
    return table


def best_classes(key: np.ndarray, own: np.ndarray, n: np.ndarray, at_hand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class with the largest of ``gains`` for each of many words at once, and that
    gain. ``key`` is (word * 2 + side) * classes + class, one for every neighbour, by
    word. Words that have a class few times beside them, nearly all, share one product of
    matrices for each number of times."""
    width, every = len(n), np.arange(len(n))
    best, most = np.empty(len(own), np.int64), np.empty(len(own))
    row, f, sums = key // (2 * width), _f(n), (n.sum(axis=1), n.sum(axis=0))
    step = max(1, _CELLS_AT_ONCE // (2 * width))
    for first in range(0, len(own), step):
        last = min(first + step, len(own))
        part = key[np.searchsorted(row, first):np.searchsorted(row, last)] - first * 2 * width
        near = np.bincount(part, minlength=(last - first) * 2 * width).reshape(-1, 2, width).transpose(1, 0, 2).astype(float)
        o, w, (b, a) = own[first:last], np.arange(last - first), near  # before, after
        a_own, b_own = a[w, o], b[w, o]
        total = np.zeros((last - first, width))
        for side, (beside, of_own, lines) in enumerate(((b, n[:, o].T, n.T), (a, n[o], n))):
            beside = beside.copy()
            beside[w, o] = 0
            for k in range(1, _TIMES_AT_HAND):
                if (some := beside == k).any():
                    total += some.astype(float) @ at_hand[1 - side, k]
            r, d = np.nonzero(beside >= _TIMES_AT_HAND)
            if len(r):
                # ``lines`` of class c hold its counts beside each d: what k more of d add to them.
                line, k = lines[:, d].T, beside[r, d][:, None]
                added = _f(line + k) - _f(line)
                added[np.arange(len(d)), d] = 0
                total[np.unique(r)] += np.add.reduceat(added, np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])))
            taken = np.where(beside > 0, _f(of_own - beside) - _f(of_own), 0.0)
            total += taken.sum(axis=1, keepdims=True) - taken
        total += (_f(n[o, o] - a_own - b_own) - f[o, o])[:, None]
        total += _f(n[o] - a + b_own[:, None]) - f[o]
        total += _f(n[:, o].T + a_own[:, None] - b) - f[:, o].T
        total += _f(n[every, every] + a + b) - f[every, every]
        for s, m in ((sums[0], a.sum(axis=1)), (sums[1], b.sum(axis=1))):
            total -= (_f(s[o] - m) - _f(s[o]))[:, None] + _f(s + m[:, None]) - _f(s)
        total[w, o] = 0
        total[:, width - 1] = -np.inf  # the class of the end
        best[first:last] = total.argmax(axis=1)
        most[first:last] = total.max(axis=1)
    return best, most


def class_bigrams(cells: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """``[c, d]``: how often class ``d`` follows class ``c``."""
    out = np.zeros((cells.shape[2], cells.shape[2]))
    np.add.at(out, classes, cells[1])
    return out


def _f(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.where(x > 0, x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """What the classes add to the log likelihood of the text."""
    return float(_f(bigrams).sum() - _f(bigrams.sum(axis=1)).sum() - _f(bigrams.sum(axis=0)).sum())


def gains(bigrams: np.ndarray, before: np.ndarray, after: np.ndarray, own: int) -> np.ndarray:
    """What it gains to move a unit of class ``own`` with these neighbours to each class."""
    n, every = bigrams, np.arange(len(bigrams))
    row, column = _f(n[own] - after) - _f(n[own]), _f(n[:, own] - before) - _f(n[:, own])
    rows, columns = _f(n + after) - _f(n), _f(n + before[:, None]) - _f(n)
    total = row.sum() - row[own] - row + rows.sum(axis=1) - rows[every, own] - rows[every, every]
    total += column.sum() - column[own] - column + columns.sum(axis=0) - columns[own, every] - columns[every, every]
    total += _f(n[own, own] - after[own] - before[own]) - _f(n[own, own])
    total += _f(n[own] - after + before[own]) - _f(n[own])
    total += _f(n[:, own] + after[own] - before) - _f(n[:, own])
    total += _f(n[every, every] + after + before) - _f(n[every, every])
    for sums, times in ((n.sum(axis=1), after.sum()), (n.sum(axis=0), before.sum())):
        total -= _f(sums[own] - times) - _f(sums[own]) + _f(sums + times) - _f(sums)
    total[own] = 0.0
    return total


def exchanged(cells: np.ndarray, classes: np.ndarray, end: int, turn: int) -> np.ndarray:
    """One round: every second unit before ``end``, frequent ones first, moves to its best
    class. Class counts follow each move; a unit's own neighbours are those at the round's
    start, so the other half of the units stays where it is until the next round."""
    classes, bigrams = classes.copy(), class_bigrams(cells, classes)
    order = np.argsort(-cells[0, :end].sum(axis=1), kind="stable")
    for unit in order[turn % 2::2]:
        before, after, own = cells[0, unit], cells[1, unit], classes[unit]
        if not before.any():
            continue
        gain = gains(bigrams, before, after, own)
        gain[-1] = -np.inf  # the class of the end
        best = int(gain.argmax())
        if gain[best] > 1e-9:
            bigrams[own] -= after
            bigrams[best] += after
            bigrams[:, own] -= before
            bigrams[:, best] += before
            np.maximum(bigrams, 0, out=bigrams)
            classes[unit] = best
    return classes


def cluster(ids: DataFrame, units: Units, order: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every unit, and the class bigrams, for ``n`` classes and the end's. A
    round that lowers the likelihood is not kept. ``order`` lists the units of the head by
    frequency, to start from, ``groups`` the group of every word of the tail."""
    end, head = units.end, np.arange(units.end + 1)
    classes = np.empty(end + 1, np.int64)
    classes[order] = np.arange(len(order)) % n
    classes[end] = n
    rows = np.concatenate([head, len(units.words) + groups])  # the tail follows its groups
    cells = neighbours(ids, end, rows, classes[rows], end + 1, n + 1)
    best = (likelihood(class_bigrams(cells, classes)), classes, cells)
    for turn in range(ROUNDS):
        classes = exchanged(cells, best[1], end, turn)
        cells = neighbours(ids, end, rows, classes[rows], end + 1, n + 1)
        value = likelihood(class_bigrams(cells, classes))
        if value <= best[0]:
            cells = best[2]
            continue
        best = (value, classes, cells)
    if not len(units.tail):
        return best[1], class_bigrams(best[2], best[1])

    # From here on the tail's words are rows by class: they have moves of their own.
    def counted(classes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.concatenate([head, end + 1 + classes[end + 1:]])
        cells = neighbours(ids, end, rows, classes, end + n + 2, n + 1)
        bigrams = class_bigrams(cells, np.concatenate([classes[:end + 1], np.arange(n + 1)]))
        return likelihood(bigrams), classes, cells, bigrams

    near = keep(near_tail(ids, units), "near")
    now = counted(best[1][rows])
    for turn in range(TAIL_ROUNDS):
        classes = now[1].copy()
        moved, to = tail_moves(near, units, classes, now[3], turn)
        classes[moved] = to
        tried = counted(classes)
        if tried[0] > now[0]:
            now = tried
        fixed = np.concatenate([now[1][:end + 1], np.arange(n + 1)])
        classes = now[1].copy()
        classes[:end + 1] = exchanged(now[2], fixed, end, turn)[:end + 1]
        tried = counted(classes)
        if tried[0] > now[0]:
            now = tried
    return now[1], now[3]


@dataclass
class Model:
    """What every task needs to score a text, but the counts of rare words."""

    units: Units
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    shares: np.ndarray  # log10 of 1 / (N + DELTA (V + 1)) of each class; 0 for the end
    known: np.ndarray  # hashes of the most frequent words, in order
    times: np.ndarray
    tokens: int
    distinct: int
    texts: int


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts, from the rows not held out."""
    texts = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text")
    n_texts = texts.count()
    counts = keep(word_counts(texts, SUFFIXES), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    known = frequent(counts.select("word", "n"), MOST_FREQUENT).toArrow()
    known_words = known["word"].to_numpy().view(np.uint64)
    order = np.argsort(known_words)
    known_words, times = known_words[order], known["n"].to_numpy()[order]
    chosen = np.sort(np.argsort(-times, kind="stable")[:UNITS])
    rest = counts.where(F.col("n") >= LEAST).select("word", "suffix").toArrow()
    tail, groups = rest["word"].to_numpy().view(np.uint64), rest["suffix"].to_numpy()
    order = np.argsort(tail)
    order = order[~np.isin(tail[order], known_words[chosen])]
    units = Units(known_words[chosen], SUFFIXES, tail[order])
    ids = keep(unit_rows(texts, units), "units")
    by_frequency = np.concatenate([np.argsort(-times[chosen], kind="stable"), len(chosen) + np.arange(SUFFIXES)])
    classes, bigrams = cluster(ids, units, by_frequency, groups[order], class_number(len(chosen) + len(order)))
    smoothed = bigrams + ALPHA
    transitions = np.log10(smoothed / smoothed.sum(axis=1, keepdims=True))
    sums = _class_sums(counts, units, classes, len(bigrams))
    shares = -np.log10(sums[:, 0] + DELTA * (sums[:, 1] + 1))
    shares[-1] = 0.0
    return Model(units, classes, transitions, shares, known_words, times, total.n + n_texts, total.v + (n_texts > 0), n_texts), counts


def _class_sums(counts: DataFrame, units: Units, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """``[c] = (N, V)``: tokens and different words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast((units, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        sums = np.zeros((2, n_classes), np.int64)
        for batch in batches:
            words, groups, n = (batch.column(name).to_numpy() for name in ("word", "suffix", "n"))
            c = of[own.by_group(words.view(np.uint64), groups.astype(np.int64))]
            np.add.at(sums[0], c, n)
            sums[1] += np.bincount(c, minlength=n_classes)
        yield pa.RecordBatch.from_arrays([_int64(np.arange(n_classes)), *map(_int64, sums)], ["class", "n", "v"])

    sums = np.zeros((n_classes, 2))
    by_task = counts.select("word", "suffix", "n").mapInArrow(run, "class long, n long, v long")
    for row in by_task.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sums[row["class"]] = row.n, row.v
    return sums


_PARTS = "row_key long, doc_id long, held_out boolean, word long, times long, n_tokens long, n_known long, base double, score double"


def parts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows that add up to each document: in the first what its task can tell, and one
    for each word that is not among the most frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        plus_one, plus_delta = np.log10(own.times + 1.0), np.log10(own.times + DELTA)
        for batch in batches:
            keys = np.asarray(batch.column("row_key"))
            for words in words_of(batch.column("text")):
                n, hashes = words.last - words.first, words.hashes()
                row = np.repeat(np.arange(n), np.diff(words.offsets))
                place, seen = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                if len(own.known):
                    place = np.minimum(np.searchsorted(own.known, hashes), len(own.known) - 1)
                    seen = own.known[place] == hashes
                tokens, before = with_ends(own.units.of(words, hashes), words.offsets, own.units.end)
                c, d = own.classes[tokens], own.classes[before]
                token_row = np.repeat(np.arange(n), np.diff(words.offsets) + 1)
                score = np.bincount(token_row, own.transitions[d, c] + own.shares[c], n) + np.bincount(row[seen], plus_delta[place[seen]], n)
                base = np.bincount(row[seen], plus_one[place[seen]], n).astype(float)
                known = np.bincount(row[seen], minlength=n) + (own.texts > 0)
                base += np.log10(own.texts + 1.0) - (np.diff(words.offsets) + 1) * np.log10(own.tokens + own.distinct + 1.0)
                rare_row, rare = row[~seen], hashes[~seen]
                sort = np.lexsort((rare, rare_row))
                rare_row, rare = rare_row[sort], rare[sort]
                starts = np.flatnonzero(np.concatenate([[True], (rare_row[1:] != rare_row[:-1]) | (rare[1:] != rare[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(starts, len(rare)))
                # A row for the document itself: a key that no partition gathers, 0 times.
                rows = np.concatenate([np.arange(n), rare_row[starts]])
                word = np.concatenate([mixed(keys[words.first:words.last].astype(np.uint64)), rare[starts]])
                zeros = np.zeros(len(starts))
                at = pa.array(rows + words.first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_key").take(at), batch.column("doc_id").take(at), batch.column("held_out").take(at), _int64(word),
                    _int64(np.concatenate([np.zeros(n), times])), _int64(np.concatenate([np.diff(words.offsets) + 1, zeros])),
                    _int64(np.concatenate([known, zeros])), pa.array(np.concatenate([base, zeros])), pa.array(np.concatenate([score, zeros]))],
                    ["row_key", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"])

    rows = numbered(docs, "doc_id", "text").select("row_key", "doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, _PARTS)


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = parts(docs, model).join(counts.select("word", "n").hint("shuffle_hash"), "word", "left")
    sums = joined.groupBy("row_key", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10(n + 1.0)).alias("base_score"),
        F.sum(F.col("score") + F.col("times") * F.log10(n + DELTA)).alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scores(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) that are not held out; score all."""
    model, counts = learn(docs)
    return scored(docs, model, counts)
