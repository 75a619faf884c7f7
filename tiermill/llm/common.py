"""Session settings and small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.session import stored, tune

# A batch sent to a Python worker is small in rows and in bytes, so that a run of very long texts cannot fill it.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings and the batch sizes used here."""
    tune(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def keep(df: DataFrame, purpose: str, narrow: int = 1) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, size known to the planner.

    A narrow table is written by ``1 / narrow`` of the tasks, as its files would otherwise be many and tiny.
    """
    if narrow > 1:
        df = df.coalesce(max(1, tasks(df.sparkSession) // narrow))
    return stored(df, purpose)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one, called ``row``, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))


def own(name: str) -> Column:
    return F.col("row").getField(name)


def restored(columns: list[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """The carried columns, some of them replaced."""
    changed = changed or {}
    return [changed[c].alias(c) if c in changed else own(c).alias(c) for c in columns]


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def _release() -> None:
    """Give freed memory back to the system, where the C library can: a worker that goes on to the next stage keeps it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task function whose worker gives its memory back when the task ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return work


SLOT = 15


def bit_filter(values: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter of ``2**bits`` bits that knows every value of the frame's one column of longs, by its lowest bits. Its
    size is fixed; where the values are many it knows others as well, so what it lets pass is joined afterwards."""
    place = F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    rows = values.groupBy(F.shiftright(place, SLOT).cast("int").alias("slot")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << SLOT) - 1))).alias("bits")
    )
    slots = np.zeros((1 << max(0, bits - SLOT), 1 << SLOT - 3), np.uint8)
    for row in rows.collect():
        slots[row.slot] = np.frombuffer(bytes(row.bits), np.uint8)
    return slots.ravel()


def in_filter(flat: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the longs the filter knows."""
    place = values & (8 * len(flat) - 1)
    return (flat[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
