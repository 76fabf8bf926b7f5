"""Where intermediate tables are kept.

A step whose result is read more than once, or whose partition numbers must stay
what they were, is written to the shared folder of ``spark.checkpoint.dir`` and
read back. That ends its lineage: a lost executor costs a re-read, and the next
step scans only the columns it needs.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session. A local session that names none
    gets a temporary folder; a cluster session must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="paneledger-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/paneledger/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = new_path(df.sparkSession, label)
    _held.stored[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class _Held(threading.local):
    """Tables in memory and stored folders, by scope, of one thread."""

    def __init__(self) -> None:
        self.memory: list[list[DataFrame]] = [[]]
        self.stored: list[list[tuple[SparkSession, str]]] = [[]]


_held = _Held()


def remember(df: DataFrame) -> DataFrame:
    """Keep ``df`` in executor memory, spilling to disk, until its scope ends.

    The engine finds kept tables by their plan, and two reads of one path have equal
    plans even if the files have changed; a mark of its own keeps this table for the
    frames that are derived from it.
    """
    own = df.selectExpr("*", f"'{uuid.uuid4().hex}' AS kept_as").drop("kept_as")
    _held.memory[-1].append(own.persist())
    return own


def release() -> None:
    """Free what the current scope has kept: tables in memory, and stored folders,
    its own only. Frames that were built on them end with it; build them anew."""
    while _held.memory[-1]:
        _held.memory[-1].pop().unpersist()
    while _held.stored[-1]:
        delete(*_held.stored[-1].pop())


@contextmanager
def scope() -> Iterator[None]:
    """What is kept inside is freed at the end, also after an error."""
    _held.memory.append([])
    _held.stored.append([])
    try:
        yield
    finally:
        release()
        _held.memory.pop()
        _held.stored.pop()
