from __future__ import annotations

import json

import pytest
from tokenizers import Tokenizer

from paneledger.llm import token_counts
from paneledger.llm.registry import TOKENIZER, queries


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    return Tokenizer.from_file(TOKENIZER)


def test_odd_rows(spark, documents, library):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "  12"), (None, "   7"), (4, " lead\n\n  two  \tx "), (5, "<|endoftext|> a<|endoftext|>b  <|endoftext|>"),
            (6, "word " * 20_000), (7, "x" * 3000), (8, "é　日本 \x85 \x1c q"), (9, "\n \n"), (10, "don't  we'll")]
    for most in (0, 3, 1000):
        got = token_counts.token_counts(documents(rows).selectExpr("*", "1 AS row_key", "'' AS piece"), TOKENIZER, most).collect()
        expected = [(i, len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)) for i, text in rows]
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(documents([]), TOKENIZER).collect() == []


def test_query(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    expected = sorted((row.doc_id, len(row.text.encode()), n := len(library.encode(row.text, add_special_tokens=False).ids), n > 512) for row in docs)
    assert sorted(map(tuple, queries()["op3_token_counts"](spark, small).collect())) == expected


def test_refuses_other_splitters():
    with open(TOKENIZER, encoding="utf-8") as file:
        parsed = json.load(file)
    parsed["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        token_counts.check_splits(json.dumps(parsed))
