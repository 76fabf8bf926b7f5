from __future__ import annotations

import math
import random
from itertools import product

import pytest

from paneledger.llm import url_rules
from paneledger.llm.registry import URL_RULES, queries
from paneledger.llm.url_rules import Segmenter, judge


def parts_of(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host: str, path: str) -> tuple[str, str] | None:
    fitting = [(rule + start, verdict) for rule, start, verdict in URL_RULES
               if (host == rule or host.endswith("." + rule)) and path.startswith(start)]
    return max(fitting, key=lambda found: len(found[0]), default=None)


URLS = [
    None, "", "no scheme.org/", "http://org/", "HTTP://A.ORG/x", "https://example.org/es/1", "https://a.example.org/es/1", "http://notexample.org/es/1",
    "http://example.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/3#t", "http://x.com", "http://x.com?/fr/",
    "ftp://x.com#://y.org/", "a://b://c.org/", "http://example.net/en/1", "http://É.Org/q", "http://x.com/a\nb", "http://.org/", "http://x..org/",
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, url, "<p>some words") for k, url in enumerate(URLS)] + [(None, "http://a.org/", None), (0, "http://b.org/", ""), (0, "http://b.org/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS rule", "2 AS host")
    got = judge(frame, URL_RULES).collect()
    expected = [(page_id, *parts_of(url), rule_of(*parts_of(url))) for page_id, url, _ in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((*e[:3], e[3] and e[3][0]) for e in expected), key=str)
    assert {(r.rule, r.verdict) for r in got if r.rule} == {e[3] for e in expected if e[3]}
    assert all(r.verdict in ("allow", "block") for r in got)
    assert judge(frame.limit(0), URL_RULES).collect() == []


def test_split_is_the_cheapest():
    rng = random.Random(1)
    words = Segmenter({word: rng.randint(1, 90) for word in ["a", "ab", "abc", "bc", "b", "ca", "cab", "bb", "acab"]})
    for _ in range(200):
        name = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        def cost(cuts):
            marks = [0, *(at + 1 for at, cut in enumerate(cuts) if cut), len(name)]
            return sum(words.cost(name[a:b]) for a, b in zip(marks, marks[1:]))
        best = min(cost(cuts) for cuts in product([0, 1], repeat=len(name) - 1))
        assert math.isclose(sum(map(words.cost, words.split(name))), best)
    assert Segmenter({"cheap": 50, "flights": 30, "che": 2}).host_words("cheapflights24.co-op.com") == ["h:cheap", "h:flights", "h:#2", "h:co", "h:op", "t:com"]


def test_classifier_follows_words(spark):
    """Names seen under blocking rules are blocked elsewhere too."""
    html = "<p>casino poker garden flowers</p>" * 3
    rows = [(k, f"http://casino{k}.bad/poker/1", html) for k in range(30)] + [(100 + k, f"http://garden{k}.good/flowers/2", html) for k in range(30)]
    rows += [(200, "http://bestcasino.net/poker", html), (201, "http://mygarden.net/flowers", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {row.page_id: row for row in judge(pages, [("bad", "/", "block"), ("good", "/", "allow")]).collect()}
    assert got[200].rule is None and got[200].verdict == "block" and got[201].verdict == "allow"


def test_counts_as_by_hand(spark):
    pages = spark.createDataFrame([("The the <b>CAT</b>s x1y a " + "q" * 30,), (None,), ("the",)], "html string")
    got = {row.piece: row.n for row in url_rules.page_words(pages).collect()}
    assert got == {b"the": 3, b"cat": 1}


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_query(spark, small, folder):
    path = small.replace("sf0.001", folder)
    urls = {row.page_id: row.url for row in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries()["op8_url_rules"](spark, path).collect()
    assert len(got) == len(urls)
    for row in got:
        host, where = parts_of(urls[row.page_id])
        rule = rule_of(host, where)
        assert (row.host, row.path, row.rule) == (host, where, rule and rule[0]) and (rule is None or row.verdict == rule[1])
    assert any(row.rule is None for row in got)
