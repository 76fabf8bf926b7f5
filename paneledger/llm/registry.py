"""Queries of this subpackage by name, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneledger.llm import bpe, brown, exact_dedup, merkle, mincut, periodic, ppm, quality, set_join, spaced_seeds, surrogates, token_counts, url_rules
from paneledger.llm.text import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Stands for a secret that a deployment takes from its own store.
SURROGATE_KEY = b"surrogates of the documents table"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, SURROGATE_KEY, count="n_entities")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.identify(docs, ppm.learn(docs))


def op7_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_classes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts, told by a hash of their id, repeats a
    period from one of its words on: the case that the query's contract plants."""
    words = docs.selectExpr("doc_id", "text", "crc32(string(doc_id)) AS h", "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '') AS words")
    sized = words.selectExpr("*", "coalesce(size(words), 0) AS n", "h DIV 10 AS g").selectExpr("*", "int(g % greatest(n, 1)) AS a").selectExpr(
        "*", "int(1 + (n - a) DIV (3 + g % 8)) AS p")
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a) DIV p + 1))), 1, n - a)"
    return sized.selectExpr("doc_id", f"IF(h % 10 = 0 AND n > 0, array_join(concat(slice(words, 1, a), {tail}), ' '), text) AS text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs_of(with_tails(table(spark, sf_dir, "documents")), "doc_id")
    best = "reduce(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), " \
        "(a, r) -> IF(a IS NULL OR r.length * a.period > a.length * r.period, r, a))"
    return found.selectExpr("doc_id", "bigint(size(runs)) AS n_runs", f"{best} AS best", "runs", "collapsed", "n_words").selectExpr(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", "1000 * best.length DIV best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256", "n_words")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, told by a hash of its id, is tampered with: it loses its line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.build(merkle.leaves(table(spark, sf_dir, "documents"), {"text": tampered})).versions()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_token_counts": op3_token_counts,
        "op4_surrogates": op4_surrogates,
        "op5_main_text": op5_main_text,
        "op6_language": op6_language,
        "op7_brown_score": op7_brown_score,
        "op8_url_rules": op8_url_rules,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_decontamination": op10_decontamination,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_jaccard_join": JACCARD_SQL, "op11_exact_dedup": COPIES_SQL, "op13_merkle_manifest": manifest_sql()}


def manifest_sql(in_group: int = 13, above: int = 6) -> str:
    """The tree level by level: enough levels for 3 ** in_group rows of one source, and
    3 ** above sources. ``w`` has, for every document, its place in the level, the nodes
    beside its way so far and what its tampered leaf has become."""
    def counted(text: str) -> str:
        return f"coalesce(octet_length(encode({text}::VARCHAR)) || ':' || {text}::VARCHAR, '-')"

    def row(text: str) -> str:
        return "sha256(" + " || ".join(map(counted, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    bits = "flatten([[(ascii(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    steps = [f"""
rows AS MATERIALIZED (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, {row("text")} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS f FROM documents),
n0 AS (SELECT g, pos, leaf AS d FROM rows), w0 AS (SELECT doc_id, g, pos, leaf, f, '' AS beside, CAST(0 AS BIGINT) AS copied FROM rows)"""]
    for k in range(in_group + above + 1):
        if k == in_group:
            steps.append(f"""
places AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM n{k}),
n{k + 1} AS (SELECT 'all' AS g, pos, d FROM places),
w{k + 1} AS (SELECT doc_id, 'all' AS g, p.pos, leaf, f, beside, copied, p.d AS subroot FROM w{k} w JOIN places p ON p.g IS NOT DISTINCT FROM w.g)""")
            continue
        last = ", subroot" if k > in_group else ""
        steps.append(f"""
r{k} AS MATERIALIZED (SELECT g, pos // 3 AS up, list(d ORDER BY pos) AS run, any_value(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM n{k}) GROUP BY ALL),
n{k + 1} AS (SELECT g, up AS pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM r{k}),
w{k + 1} AS MATERIALIZED (SELECT doc_id, w.g, up AS pos, leaf, copied + (n > 1)::INT AS copied,
  CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(run[:pos % 3] || [f] || run[pos % 3 + 2:], '')) END AS f,
  beside || array_to_string(run[:pos % 3] || run[pos % 3 + 2:], '') AS beside{last}
  FROM w{k} w JOIN r{k} r ON r.g IS NOT DISTINCT FROM w.g AND r.up = w.pos // 3)""")
    end = in_group + above + 1
    return f"""WITH {",".join(steps)}
SELECT w.doc_id, w.leaf, subroot, d AS root, sha256(beside) AS proof_sha256, w.f AS folded_root, w.f = d AS verified,
  CASE WHEN rows.f = rows.leaf THEN 0 ELSE copied + 1 END AS n_copied
FROM w{end} w CROSS JOIN n{end} JOIN rows ON rows.doc_id = w.doc_id
"""


COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = s.doc_id
"""
