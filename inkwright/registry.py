"""Every query of the library, by name, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, built, citations, curation, dates, documents, extras, facets, files, papers, records, retrieval, reviews, workflow

PARTS = (retrieval, analytics, documents, records, workflow, curation, citations, dates, extras, reviews, files, facets, papers, built)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.r01_cosine_topk(spark, sf_dir)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
