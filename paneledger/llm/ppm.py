"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A byte is coded in
the longest context that has been followed by it; every longer context that is known
is left with its escape probability d / (n + d), for n occurrences and d different
successors, and the byte then costs c / (n + d); a byte that no context knows costs
one of 257. The statistics are frozen after learning, so the code length of a text
is exact, and the text goes to the language that needs the fewest bits. Words (of the
lower-cased text) are coded one by one between white space, contexts do not reach
across it: so a word has one code length per language, and a block of texts codes
each different word once.

The trees are learnt from at most ``sample`` documents per language (those whose id
has the smallest hash) and keep at most ``most_contexts`` (context, successor) pairs
per language, the most frequent; languages are those of the labels.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing could be learnt; equally short codes go to the first language in
order; rows without a language, or without an id, teach nothing, and a null id is not
held out; repeated rows and ids keep a row each; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneledger.llm.hashing import words_of
from paneledger.llm.keyed import only
from paneledger.llm.text import frequent, numbered
from paneledger.workspace import keep

ORDER = 4
SAMPLE, MOST_CONTEXTS = 1_000, 400_000
BLOCK_BYTES = 4 << 20
_SPACE = 32
_TAG = 40  # a code is (order, context bytes, byte); the order stands above 5 bytes


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as one row of bytes, a space before and after each; the places of
    the bytes to code, and how much context each has in its word."""
    lengths = ends - starts + 2
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    within = np.arange(firsts[-1]) - np.repeat(firsts[:-1], lengths)
    source = np.repeat(starts, lengths) + within - 1
    row = np.where((within == 0) | (within == np.repeat(lengths, lengths) - 1), _SPACE, data[np.clip(source, 0, max(0, len(data) - 1))]).astype(np.int64)
    places = np.flatnonzero(within > 0)
    return row, places, within[places]


def codes(row: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """Codes of the bytes at ``places`` with ``order`` bytes of context."""
    code = row[places].copy()
    for back in range(1, order + 1):
        code |= row[places - back] << (8 * back)
    return code | order << _TAG


def context_of(code: np.ndarray) -> np.ndarray:
    order = code >> _TAG
    return (code & (1 << _TAG) - 1) >> 8 | order << _TAG


def shorter(code: np.ndarray) -> np.ndarray:
    """The codes with the oldest context byte taken away."""
    order = code >> _TAG
    return code & ((1 << 8 * order) - 1) | (order - 1) << _TAG


@dataclass
class Trees:
    """``bits[g, l]``: bits of the byte of ``grams[g]`` after its context in language
    ``l``, escapes within included; ``escape[c, l]``: bits to leave ``contexts[c]``."""

    languages: list[str]
    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray

    def word_bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each word in each language."""
        row, places, known = coded(data, starts, ends)
        total = np.zeros((len(places), len(self.languages)), np.float32)
        left = np.arange(len(places))
        for order in range(ORDER, -1, -1):
            fits = known[left] >= order
            at = left[fits]
            code = codes(row, places[at], order)
            place, found = _find(self.grams, code)
            total[at[found]] += self.bits[place[found]]
            place, seen = _find(self.contexts, context_of(code[~found]))
            total[at[~found][seen]] += self.escape[place[seen]]
            left = np.concatenate([left[~fits], at[~found]])
        total[left] += np.float32(np.log2(257))
        return np.add.reduceat(total, np.cumsum(np.concatenate([[0], (ends - starts + 1)[:-1]])), axis=0)


def _find(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    place = np.minimum(np.searchsorted(table, code), len(table) - 1)
    return place, table[place] == code


def trees(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Frozen statistics from the (code, count) arrays of each language."""
    languages = sorted(counts)
    grams = np.unique(np.concatenate([counts[l][0] for l in languages])) if languages else np.zeros(0, np.int64)
    contexts = np.unique(context_of(grams))
    times = np.zeros((len(grams), len(languages)))
    for at, language in enumerate(languages):
        times[np.searchsorted(grams, counts[language][0]), at] = counts[language][1]
    of = np.searchsorted(contexts, context_of(grams))
    n, d = (np.zeros((len(contexts), len(languages))) for _ in range(2))
    np.add.at(n, of, times)
    np.add.at(d, of, times > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(n > 0, np.log2((n + d) / d), 0.0)
        bits = np.log2((n + d)[of] / times)
    order = grams >> _TAG
    for k in range(ORDER + 1):
        own = np.flatnonzero(order == k)
        below = np.log2(257) if k == 0 else bits[np.searchsorted(grams, shorter(grams[own]))]
        bits[own] = np.where(times[own] > 0, bits[own], escape[of[own]] + below)
    return Trees(languages, grams, bits.astype(np.float32), contexts, escape.astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, most_contexts: int = MOST_CONTEXTS) -> Trees:
    """Trees from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    usable = numbered(docs, "doc_id", "lang", "text").where(~held_out() & F.expr("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"))
    hashed = usable.select("row_key", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("hash"))
    # About twice as many as are wanted have a hash in this share of the range, whatever the table.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.count("*")) * (1 << 30)
    near = hashed.join(F.broadcast(hashed.groupBy("lang").agg(share.alias("most"))), "lang").where("hash <= most")
    by_hash = Window.partitionBy("lang").orderBy("hash", "row_key")
    chosen = near.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= sample)
    texts = only(numbered(docs, "lang", "text"), keep(chosen.select("row_key"), "sample"), "row_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column("lang").to_pylist(), object)
            for language in sorted(set(languages)):
                own = pc.utf8_lower(batch.column("text").filter(pa.array(languages == language)))
                for words in words_of(own):
                    if len(words.starts):
                        row, places, known = coded(words.data, words.starts, words.ends)
                        code = np.concatenate([codes(row, places[known >= order], order) for order in range(ORDER + 1)])
                        code, n = _counted(code)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([language] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    grams = keep(texts.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in grams.select("lang").distinct().collect():
        rows = frequent(grams.where(F.col("lang") == row.lang), most_contexts).select("code", "n").toArrow()
        found[row.lang] = rows["code"].to_numpy(), rows["n"].to_numpy()
    return trees(found)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


def text_bits(model: Trees, texts: pa.Array) -> np.ndarray:
    """Code lengths of whole texts, a row per text and a column per language."""
    total = np.zeros((len(texts), len(model.languages)))
    for words in words_of(pc.utf8_lower(texts.cast(pa.large_string())), BLOCK_BYTES):
        if not len(words.starts):
            continue
        _, first, each = np.unique(words.hashes(), return_index=True, return_inverse=True)
        bits = model.word_bits(words.data, words.starts[first], words.ends[first])
        sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits[each], axis=0, dtype=np.float64)])
        total[words.first:words.last] = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
    return total


def identify(docs: DataFrame, model: Trees) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: the language of the shortest code, and
    its share of the probabilities that the languages give the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = batch.column("text"), np.array([*shared.value.languages, "und"], object)
            spoken = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if len(languages) == 1 or not batch.num_rows:
                best, score = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            else:
                bits = text_bits(shared.value, texts)
                best = np.where(spoken, bits.argmin(axis=1), len(languages) - 1)
                score = np.where(spoken, 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held"), pa.array(languages[best], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
