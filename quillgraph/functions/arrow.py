"""What keeps Python workers small."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Bounds what a Python worker is handed at once: rows and bytes of an Arrow batch. Spark reads these settings
    when a plan runs, after its function has returned, so they stay for the session; smaller ones are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        given = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if given not in range(1, most + 1):
            spark.conf.set(key, str(most))


def arrow_rows(rows):
    """`rows` (a function for mapInArrow) that hands free memory back when its task ends: Spark uses a Python worker
    again, and what it keeps adds up with the executor's own."""

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library is another
                ctypes.CDLL(None).malloc_trim(0)

    return all_rows
