"""Token counts without token ids.

A text is cut into pieces that no pre-token crosses (``bpe.cut``), so its token
count is the sum over its pieces. Every distinct piece of the corpus is counted by
the library once; the counts are joined to the piece frequencies of each document
and summed.

The join is split by frequency. The ``most_frequent`` most frequent pieces, a
bounded table, are broadcast, and a document's task adds them up on the spot; all
other pieces, none of which is frequent, go through a shuffle join by piece.

Only byte-level BPE files of the tokenizers library are taken whose pre-tokenizer
splits by its own pattern and adds no prefix space, as only there the cuts are
exact; an added token must not hold a space followed by something else.

Cases: a null text is an empty one with 0 tokens; null or repeated ids keep one row
each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.llm.bpe import _CUT, cut
from paneledger.llm.text import frequent, numbered, piece_counts, texts_of
from paneledger.workspace import keep

MOST_FREQUENT = 200_000
LENGTH_FREQUENT = 64
# First pieces have no space before them. No later piece starts with white space,
# so these marks cannot be taken for one.
FIRST, NONE = "  ", "   "


def keys(text: str) -> list[str]:
    """The pieces of a text as keys: a first piece is marked, any other stands for a
    space and itself."""
    parts = cut(text)
    parts[0] = FIRST + parts[0]
    return parts


def _encoded_keys(text: str) -> list[bytes]:
    return [key.encode() for key in keys(text)]


def check_splits(tokenizer: str) -> None:
    """Refuse a tokenizer file for which the cuts would not be exact."""
    parsed = json.loads(tokenizer)
    splitter = parsed["pre_tokenizer"] or {}
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or parsed["normalizer"]:
        raise ValueError("token counts by piece need a byte-level tokenizer that splits by its own pattern")
    if any(_CUT.search(token["content"]) or token["lstrip"] or token["rstrip"] for token in parsed["added_tokens"]):
        raise ValueError("an added token holds a space followed by something else")


def count_pieces(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """``pieces`` of (piece binary, n) with ``tokens``, the library's count of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(tokenizer)
        library.no_truncation()
        library.no_padding()
        for batch in batches:
            texts = [key.decode() for key in batch.column(0).to_pylist()]
            texts = [key[len(FIRST):] if key.startswith(FIRST) else " " + key for key in texts]
            found = library.encode_batch_fast(texts, add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(one) for one in found], pa.int32())], ["piece", "n", "tokens"])

    return pieces.mapInArrow(run, "piece binary, n long, tokens int")


def token_counts(docs: DataFrame, tokenizer_path: str, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row per row of ``docs`` (doc_id, text)."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    check_splits(tokenizer)
    counted = keep(count_pieces(piece_counts(docs, _encoded_keys), tokenizer), "pieces")
    top = frequent(counted.where(F.length("piece") <= LENGTH_FREQUENT), most_frequent)
    known = docs.sparkSession.sparkContext.broadcast(
        {row.piece.decode(): row.tokens for row in top.select("piece", "tokens").collect()})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that add up to the document: its bytes and the tokens of frequent
        pieces in the first, one for each other piece."""
        tokens_of = known.value
        for batch in batches:
            row_keys, doc_ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for row_key, doc_id, text in zip(row_keys, doc_ids, texts_of(batch), strict=True):
                held, others, times = 0, [], []
                for key, n in Counter(keys(text)).items():
                    tokens = tokens_of.get(key)
                    if tokens is None:
                        others.append(key)
                        times.append(n)
                    else:
                        held += tokens * n
                if not others:
                    others, times = [f"{NONE}{row_key}"], [0]  # its own key, so that no partition gathers them
                rest = [0] * (len(others) - 1)
                for column, values in zip(rows, (
                    [row_key] * len(others), [doc_id] * len(others), [len(text.encode()), *rest], [held, *rest], others, times), strict=True):
                    column.extend(values)
                if len(rows[0]) > 100_000:
                    yield _batch(rows)
                    rows = ([], [], [], [], [], [])
            yield _batch(rows)

    parts = numbered(docs, "doc_id", "text").mapInArrow(
        frequencies, "row_key long, doc_id long, n_bytes long, held long, piece string, times int")
    table = counted.select(F.col("piece").cast("string").alias("piece"), "tokens").hint("shuffle_hash")
    return (
        parts.join(table, "piece", "left").groupBy("row_key", "doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), (F.sum("held") + F.sum(F.coalesce(F.col("tokens") * F.col("times"), F.lit(0)))).alias("n_tokens"))
        .drop("row_key"))


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(rows, types, strict=True)],
        ["row_key", "doc_id", "n_bytes", "held", "piece", "times"])
