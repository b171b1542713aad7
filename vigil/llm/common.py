"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_table

#: Most rows of an id list that is broadcast; longer lists are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Bytes from which on an Arrow batch is sent to Python, where the session doesn't say.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text_col: str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``."""
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(parts))


def uniform(id_col: str, seed: str) -> Column:
    """A number in (0, 1) drawn from the id alone: the same in every attempt of a task."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written under the shared checkpoint folder and read again."""
    return checkpoint_table(df.sparkSession, df, f"llm-{name}")


def sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small; ``df`` should be a staged table."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def trim() -> None:
    """Freed memory goes back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts do not add up, and a worker trimmed after each task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The byte strings of a batch in runs of about ``max_bytes``: (first row, strings)."""
    values = batch.column(column)
    start, size, run = 0, 0, []
    for i in range(len(values)):
        v = values[i].as_py() or b""
        run.append(v)
        size += len(v)
        if size >= max_bytes:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run
