"""What the text operators share: words, whole-table piece counts, frequent pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A task hands its counts on when it holds this many different pieces.
PIECES_IN_MEMORY = 400_000


# Rows per Arrow batch, for operators that hold results of whole texts.
ROWS_PER_BATCH = 1_000


def batches_of(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """From here on the session hands tasks batches of at most so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, made longer until no column's name begins like them."""
    taken, found = [c.lower() for c in columns], []
    for name in wanted:
        while any(c.startswith(name.lower()) for c in taken):
            name += "_"
        found.append(name)
    return found


def new_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``row_key``, which is unique even where ids repeat or
    are null. It depends on the split and the position in it only, so a task that
    runs again gives the same keys."""
    return docs.select(*columns).withColumn("row_key", F.monotonically_increasing_id())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [text or "" for text in batch.column(column).to_pylist()]


def piece_counts(docs: DataFrame, pieces: Callable[[str], Iterable[bytes]]) -> DataFrame:
    """``(piece, n)`` over all texts: counted inside each task, then summed by piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({
                "piece": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for text in texts_of(batch):
                counts.update(pieces(text))
                if len(counts) > PIECES_IN_MEMORY:
                    yield handed_on()
        yield handed_on()

    return docs.select("text").mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``: at most ``most`` rows, all rows
    above one threshold, which comes from a histogram of a few hundred rows."""
    level = F.floor(F.log(F.col("n").cast("double")) * 16)
    levels = counts.groupBy(level.alias("level")).count().collect()
    least, held = None, 0
    for row in sorted(levels, key=lambda row: -row["level"]):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


def sampled(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those whose key has the smallest hash. A share of the
    hash range that holds about twice as many goes first, so that the last step
    orders a bounded number of rows whatever the table."""
    share = min(1.0, 2 * most / max(1, rows.count()))
    hashed = F.xxhash64(*key)
    return rows.where(F.pmod(hashed, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(hashed, *key).limit(most)
