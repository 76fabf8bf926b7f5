"""Exact copies by digest, the frequent digests apart from all others.

A text that a third of all rows repeat must not meet in one task. Misra-Gries counters
find the digests that may be frequent: Spark's frequent-items sketch keeps a bounded
table of them per task and takes a median off all when it is full; tables merge in two
levels. A second pass counts the candidates exactly, by whole digest, and so verifies
them. At most MOST verified winners, with the row that stays of each, are broadcast, and
their copies are settled where they are scanned. Every digest on more than 7 / TRACKED of
the rows is among the candidates; what is left has smaller groups only, no larger than
one partition of a few hundred, and is shuffled by digest. The split decides where a row
is settled, never how.

Only DataFrame functions are used. Texts are read once; what is sketched, counted and
shuffled is a stored table of a 32-byte digest and the id.

Cases: a null text counts as empty; of equal texts the largest id stays, a null id is
smaller than any other, and of rows with the same text and id the first stays; columns
but ``doc_id`` and ``text`` are not read, whatever their names; an empty table gives an
empty table; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneledger.llm.keyed import only, without
from paneledger.llm.text import free_names
from paneledger.workspace import keep

# Digests that a task's counters hold, and winners that are broadcast: 64 bytes each.
TRACKED, MOST = 4_096, 1_024
# Sketches merge by so many groups of tasks, then into one.
GROUPS = 64

Form = Callable[[Column], Column]


def as_is(text: Column) -> Column:
    return text


def digest(form: Form = as_is) -> Column:
    """SHA-256 of the text in its normal ``form``, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(form(F.col("text")), F.lit("")).cast("binary"), 256))


def _told_by(hashed: Column) -> Column:
    """What tells the rows of one text and id from all others."""
    return F.sha2(F.concat(F.lower(F.hex(hashed)), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))), 256)


def digests(docs: DataFrame, form: Form = as_is) -> DataFrame:
    """``(row_key, doc_id, digest)`` of every row, stored."""
    return keep(docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", digest(form).alias("digest")), "digests")


def candidates(rows: DataFrame, tracked: int = TRACKED, most: int = MOST) -> DataFrame:
    """``hashed``: the digests with the largest Misra-Gries counters, ``most`` at most."""
    sketched = rows.select(F.xxhash64("digest").alias("hashed"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("task"))
    parts = sketched.groupBy("task").agg(F.expr(f"approx_top_k_accumulate(hashed, {tracked})").alias("counters"))
    # Grouped by a constant: an empty table has no counters to merge.
    merged = parts.withColumn("whole", F.lit("all")).groupBy("whole").agg(F.expr("approx_top_k_combine(counters)").alias("counters"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(counters, {most})")).alias("x"))
    return found.where("x.count > 1").select("x.item")


def _settled() -> tuple[Column, Column]:
    """The size of a group, and the id and key of the row that stays."""
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("row_key"))
    return F.count("*"), F.max_by(F.struct("doc_id", "row_key"), order)


def winners(rows: DataFrame, tracked: int = TRACKED, most: int = MOST) -> DataFrame:
    """``(digest, group_size, stays)`` of the candidates that have copies, counted
    exactly: one row per digest, stored."""
    likely = F.broadcast(candidates(rows, tracked, most).withColumnRenamed("item", "hashed"))
    picked = rows.withColumn("hashed", F.xxhash64("digest")).join(likely, "hashed", "left_semi")
    size, stays = _settled()
    return keep(picked.groupBy("digest").agg(size.alias("group_size"), stays.alias("stays")).where("group_size > 1"), "winners")


def copies(docs: DataFrame, form: Form = as_is, tracked: int = TRACKED, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id`` (the id of the row that stays),
    ``group_size, kept, text_sha256``."""
    return _settled_rows(digests(docs, form), tracked, most).selectExpr(
        "doc_id", "stays.doc_id AS keep_id", "group_size", "row_key = stays.row_key AS kept", "lower(hex(digest)) AS text_sha256")


def _settled_rows(rows: DataFrame, tracked: int, most: int) -> DataFrame:
    often = winners(rows, tracked, most)
    there = rows.join(F.broadcast(often), "digest")
    rest = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    size, stays = _settled()
    return there.unionByName(rest.withColumns({"group_size": size.over(group), "stays": stays.over(group)}))


def one_of_each(docs: DataFrame, form: Form = as_is, tracked: int = TRACKED, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each text. Texts are not shuffled: rows are told by their
    digest and id, and a bit table of one size picks those that may have to go. Of rows
    that repeat text and id any one stays."""
    [own] = free_names(docs.columns, "own_key")
    rows = _settled_rows(digests(docs, form), tracked, most)
    kinds = keep(rows.groupBy(_told_by(F.col("digest")).alias(own)).agg(
        F.max(F.expr("row_key = stays.row_key")).alias("stays"), F.count("*").alias("times")).where("NOT stays OR times > 1"), "kinds")
    keyed, again = docs.withColumn(own, _told_by(digest(form))), kinds.where("stays")
    once = without(keyed, kinds, own)
    return once.unionByName(_firsts(keyed, again, own)).select(docs.columns)


def _firsts(keyed: DataFrame, again: DataFrame, own: str) -> DataFrame:
    """One row for each key of ``again``, reduced where rows are scanned before they meet."""
    rows = only(keyed, again, own)
    whole = F.struct(*[F.col(f"`{c}`") for c in keyed.columns])
    return rows.groupBy(own).agg(F.first(whole).alias("row")).select("row.*")
