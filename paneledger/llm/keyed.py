"""Rows picked by key without shuffling the others.

A bit table of one fixed size, whatever the number of keys, is broadcast; rows whose
bit is not set are surely not among the keys. Only the rest is joined. Where the
table is full, everything is joined: slower, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneledger.llm.text import free_names

BITS = 1 << 23
_BUCKET = 1 << 15


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): at most BITS / 32768 rows of 4096 bytes."""
    numbers = keys.select((_bit(key) + 1).alias("bit"))  # the bitmap functions count from 1
    return numbers.groupBy((F.bitmap_bucket_number("bit") - 1).alias("bit_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def marked(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with a boolean column: may the row's key be among ``keys``?"""
    table = F.broadcast(bit_table(keys, key).withColumnsRenamed({"bit_bucket": f"{mark}_bucket", "bits": f"{mark}_bits"}))
    at = F.pmod(_bit(key), F.lit(_BUCKET)).cast("int")
    byte = F.conv(F.hex(F.substring(f"{mark}_bits", at.bitwiseAND(_BUCKET - 1) / 8 + 1, 1)), 16, 10).cast("int")
    found = rows.withColumn(f"{mark}_bucket", F.floor(_bit(key) / _BUCKET)).join(table, f"{mark}_bucket", "left")
    test = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], test.alias(mark))


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys``."""
    [mark] = free_names(rows.columns, "maybe")
    return marked(rows, keys, key, mark).where(mark).drop(mark).join(keys.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ``keys``."""
    [mark] = free_names(rows.columns, "maybe")
    tested = marked(rows, keys, key, mark)
    doubtful = tested.where(mark).drop(mark).join(keys.select(key).distinct(), key, "left_anti")
    return tested.where(f"NOT {mark}").drop(mark).unionByName(doubtful.select(rows.columns))
