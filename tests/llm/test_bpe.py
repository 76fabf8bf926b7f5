from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from paneledger.llm import bpe
from paneledger.llm.registry import RANKS, queries


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    with open(RANKS, "rb") as file:
        ranks = bpe.load_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder() -> bpe.Encoder:
    with open(RANKS, "rb") as file:
        return bpe.Encoder(bpe.load_ranks(file.read()), public_tokenizers.PATTERN)


def test_random_texts_as_the_library(encoder, library):
    rng = random.Random(3)
    letters = "abeélß 'st\n\t 　 \x1c\x85 12٣%!!日本  "
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        parts = bpe.cut(text)
        ids = list(encoder.encode_text(parts[0]))
        for part in parts[1:]:
            ids += encoder.encode_text(" " + part)
        assert ids == library.encode_ordinary(text), repr(text)
        assert encoder.decode(tuple(ids)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "x", "!" * 4097, "\n" * 900, "the" * 2000, "é" * 777])
def test_long_pieces(encoder, library, text):
    assert list(encoder.encode_text(text)) == library.encode_ordinary(text)


def test_join_is_associative(encoder):
    rng = random.Random(5)
    for _ in range(500):
        a, b, c = (encoder.merge("".join(rng.choices("thonera", k=rng.randint(1, 12))).encode()) for _ in range(3))
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c))


def test_odd_rows(spark, documents, library):
    rows = [(1, None), (2, ""), (2, "same"), (2, "same"), (None, "  x \n\n y"), (3, "word " * 30_000)]
    got = bpe.encode(documents(rows).selectExpr("*", "1 AS row_key", "'a' AS n_tokens"), RANKS, public_tokenizers.PATTERN).collect()
    assert [row.n_tokens for row in got] == ["a"] * 6
    for (_, text), row in zip(rows, got, strict=True):
        assert row.ids == library.encode_ordinary(text or "") and row.decoded == (text or "").encode()
    empty = bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "ids", "decoded"]


def test_ids_alone(spark, documents, library):
    """Without the decoded bytes, parts hold none; and a task's windows end with it."""
    rows = [(1, "one two  two\u00a0three"), (2, None)]
    got = bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN, decoded=False)
    assert got.columns[-1] == "ids" and "decoded" not in got.columns
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(1, library.encode_ordinary(rows[0][1])), (2, [])]
    parts = bpe.Parts(bpe.Encoder(bpe.load_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN), decoded=False)
    parts.add([bpe.cut("xqzvkw jjqqxzv")])
    assert {data for _, data in [*parts.firsts.values(), *parts.others.values()]} == {b""}
    parts.encoder.forget(0)
    assert not parts.encoder._windows


def test_short_parts_leave_no_windows(library):
    """Parts that are one leaf are cut from the arrays of all, ids and bytes alike."""
    encoder = bpe.Encoder(bpe.load_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    text = "xqzvkw jjqqxzv zzyxw éèqx the xqzvkw"
    parts = bpe.cut(text)
    for decoded in (True, False):
        known = bpe.Parts(encoder, decoded)
        known.add([parts, parts])
        assert not encoder._windows
        ids, again = known.encoded(parts)
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(text)
        assert again == (text.encode() if decoded else b"")


def test_short_pieces_leave_no_windows(library):
    """Parts of several short pieces are cut from the arrays of all too, and the bytes of
    many rows come from the ids of all."""
    encoder = bpe.Encoder(bpe.load_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    texts = ["xqzvkw, jjqqxzv's 12zzv!? the", "", " ", "éèqx.  zzyxw\nqq", "日本 of, the."]
    known = bpe.Parts(encoder)
    known.add([bpe.cut(text) for text in texts])
    assert not encoder._windows
    ids = [np.frombuffer(known.ids(bpe.cut(text)), "<i4") for text in texts]
    assert [row.tolist() for row in ids] == [library.encode_ordinary(text) for text in texts]
    again = encoder.decode_rows(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
    assert again.to_pylist() == [text.encode() for text in texts]
    assert encoder.decode_rows(np.zeros(0, np.int32), np.zeros(3, np.int64)).to_pylist() == [b"", b""]


def test_query(spark, small, library):
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries()["op2_byte_bpe"](spark, small).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
