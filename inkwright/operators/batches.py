"""Bounds of what a Python worker holds: small Arrow batches, and memory given back when a task ends."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes in an Arrow batch handed to Python. Whole documents travel in these, so they are kept small.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def vector_batches(spark: SparkSession) -> None:
    """Batches by bytes alone: vectors are short rows, blocks of them long ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks, and several share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches_to_batches: Callable) -> Callable:
    """A function for mapInPandas or mapInArrow that gives memory back when its task ends."""

    @functools.wraps(batches_to_batches)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from batches_to_batches(batches)
        finally:
            give_back()

    return run
