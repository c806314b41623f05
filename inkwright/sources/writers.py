"""Sinks: index tables, JSON and CSV exports, graph exports, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(chunks: DataFrame, documents: DataFrame, path: str) -> None:
    """An index is two tables under one path; chunks keep their vectors."""
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/documents")


def removed(chunks: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents without the documents of `gone` (document_id)."""
    return chunks.join(gone, "document_id", "left_anti"), documents.join(gone, "document_id", "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(parts: list[DataFrame], path: str) -> DataFrame:
    """Rows with different columns, under the union of them in first-seen order; returns what was written."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "json") -> None:
    """json, csv, or gexf (node and edge elements, one per line); anything else is written as json."""
    if kind == "csv":
        edges.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "gexf":
        quoted = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        lines = nodes.select(F.concat(F.lit('<node id="'), quoted("id"), F.lit('" label="'), quoted("title"), F.lit('"/>')).alias("value"))
        links = edges.select(F.concat(F.lit('<edge source="'), quoted("source"), F.lit('" target="'), quoted("target"), F.lit('"/>')).alias("value"))
        lines.unionByName(links).write.mode("overwrite").text(path)
    else:
        export_json(edges, path)


def markdown_table(rows: Column) -> Column:
    """An array of arrays of strings as a Markdown table; the first row is the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def artifact_manifest(artifacts: DataFrame, root: str) -> DataFrame:
    """Artifacts whose path stays under root and doesn't name a secrets folder."""
    path = F.col("path")
    inside = path.startswith(root.rstrip("/") + "/") & ~path.contains("/../") & ~F.lower(path).contains("/secrets")
    return artifacts.filter(inside)


def append_progress(events: DataFrame, path: str) -> None:
    """Progress events as JSON lines without null fields."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
