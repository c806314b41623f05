"""Keep-one and merge operators; the order that decides is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def keep_best(df: DataFrame, name: str, confidence: str, order: list[str | Column]) -> DataFrame:
    """The most confident row of each name, lower-cased and trimmed; the first one on ties."""
    return keep_first(df, [F.lower(F.trim(F.col(name)))], [F.desc(confidence), *order])


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row written for each key."""
    return keep_first(df, keys, [F.col(c).desc() if isinstance(c, str) else c for c in order])


def union_distinct(parts: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """All rows of all parts, the first of each key in order of part and `order`."""
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return keep_first(rows, [key], ["_part", *order]).drop("_part")


def fill_from_later(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: each column's first value that isn't null or blank, in order."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col(order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*first)


def merged_lines(df: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """Text of each key with repeated lines (lower-cased, trimmed) and blank ones dropped."""
    rows = df.filter(F.trim(F.col(line)) != "")
    rows = keep_first(rows, [F.col(key), F.lower(F.trim(F.col(line)))], [order])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))
