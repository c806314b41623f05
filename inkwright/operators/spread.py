"""Dealing of rows whose work is out of proportion to their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by keys over all partitions of a shuffle.

    Spark sizes tasks by bytes and would merge a few MB of slow rows into one; a given number of partitions is kept, and joins, windows
    and groups by the keys need no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
