"""Inputs of the queries: driver tables, and views on them that stand in for entities they don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as works (year: size as text), and an edge from a part to the part after it in an order's lines."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.lit(1950) + F.col("p_size")).cast("string").alias("year"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target"))
    edges = items.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("source"), "target").filter("source <> target").distinct()
    return nodes, edges


GRAPH_SQL = """
works AS (SELECT p_partkey AS id, p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year FROM part),
edges AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
nodes AS (SELECT w.*, COALESCE(o.n, 0) AS citation_count, COALESCE(i.n, 0) AS cited_by_count FROM works w
  LEFT JOIN (SELECT source, count(*) AS n FROM edges GROUP BY 1) o ON o.source = w.id
  LEFT JOIN (SELECT target, count(*) AS n FROM edges GROUP BY 1) i ON i.target = w.id)
"""
