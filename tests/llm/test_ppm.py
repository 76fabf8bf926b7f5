from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from paneledger.llm import ppm
from paneledger.llm.registry import queries


def plain_counts(texts: list[str]) -> Counter:
    """Counts of (context, byte) by walking over every word."""
    found: Counter = Counter()
    for text in texts:
        for word in text.lower().encode().split():
            row = b" " + word + b" "
            for at in range(1, len(row)):
                for order in range(min(ppm.ORDER, at) + 1):
                    found[row[at - order:at], row[at:at + 1]] += 1
    return found


def plain_bits(found: Counter, text: str) -> float:
    after: dict = {}
    for (context, byte), n in found.items():
        after.setdefault(context, {})[byte] = n
    bits = 0.0
    for word in text.lower().encode().split():
        row = b" " + word + b" "
        for at in range(1, len(row)):
            for order in range(min(ppm.ORDER, at), -1, -1):
                successors = after.get(row[at - order:at])
                if successors is None:
                    continue
                total = sum(successors.values()) + len(successors)
                if row[at:at + 1] in successors:
                    bits -= math.log2(successors[row[at:at + 1]] / total)
                    break
                bits -= math.log2(len(successors) / total)
            else:
                bits += math.log2(257)
    return bits


def as_arrays(found: Counter) -> tuple[np.ndarray, np.ndarray]:
    codes = [int.from_bytes(context + byte, "big") | len(context) << 40 for context, byte in found]
    return np.array(codes), np.array(list(found.values()))


def test_code_lengths_as_by_hand():
    spoken = {"de": ["die Straße und die Häuser", "der und das"], "en": ["the street and the houses", "of the"], "xx": ["zzz"]}
    found = {language: plain_counts(texts) for language, texts in spoken.items()}
    model = ppm.trees({language: as_arrays(counts) for language, counts in found.items()})
    texts = ["die Straße", "The houses", "", "qqq ñ 77", "zzzz z", "Undtheder " * 50]
    got = ppm.text_bits(model, pa.array(texts))
    for row, text in zip(got, texts):
        assert np.allclose(row, [plain_bits(found[language], text) for language in model.languages], rtol=1e-5)


def test_learning_counts_whole_corpus(spark):
    rows = [(k, text, "en") for k, text in enumerate(["the cat", "the dog ran", "a cat, the", "no", "the the"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [text for k, text, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    model, expected = ppm.learn(docs), ppm.trees({"en": as_arrays(plain_counts(taught))})
    assert model.languages == ["en"] and (model.grams == expected.grams).all() and np.allclose(model.bits, expected.bits)


def test_odd_rows(spark):
    long = "der und die " * 60_000
    rows = [(k, "the of and with", "en") for k in range(12)] + [(k, "der und die mit", "de") for k in range(20, 32)]
    rows += [(40, None, "en"), (41, "", None), (42, "12 34 !!", "de"), (None, "the of", "fr"), (43, long, None), (43, long, None), (44, "THE OF", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS row_key", "3 AS held_out")
    got = {row.doc_id: row for row in ppm.identify(docs.drop("row_key"), ppm.learn(docs.drop("row_key"))).collect()}
    assert len(got) == 12 + 12 + 6
    assert [got[k].lang_pred for k in (0, 20, 40, 41, 42, None, 43, 44)] == ["en", "de", "und", "und", "und", "en", "de", "en"]
    assert got[40].score == 0 and 0.5 < got[43].score <= 1 and got[None].held_out is False
    silent = ppm.learn(docs.drop("row_key").where("lang = 'xx'"))
    assert {row.lang_pred for row in ppm.identify(docs, silent).collect()} == {"und"}
    assert ppm.identify(docs.limit(0), silent).collect() == []


def test_held_out_accuracy(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    truth = {row.doc_id: row.lang for row in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries()["op6_language"](spark, path).collect()
    assert len(rows) == len(truth)
    held = [row.lang_pred == truth[row.doc_id] for row in rows if row.held_out and truth[row.doc_id]]
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows)
    assert len(held) > 200 and sum(held) > 0.97 * len(held)
