"""The corpus pipeline: documents become packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last keep the columns of documents, whatever their names. A document is known by its
doc_id; rows that repeat one stay or go together in the stages that compare documents, and rows without one stay.

Null and empty texts are clean, link with nothing and hold no item or secret, so they stay; a null text stays null until
packing, where it is one end id. An empty table stays empty. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm.common import scratch, table, written
from inkwright.llm.decontamination import leaks
from inkwright.llm.ngram_join import linked_documents
from inkwright.llm.packing import packed_documents
from inkwright.llm.secrets import redacted
from inkwright.llm.tokens import tokenizer_path
from inkwright.llm.toxicity import THRESHOLD, scored, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; each row is judged by its own text. Without labels none goes."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "__score").filter(F.col("__score") < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, with all rows that repeat it."""
    linked = linked_documents(docs)
    gone = linked.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text, also those without a doc_id. Without items none goes."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    gone = written(leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__digest")).distinct(), "gone")
    return docs.join(gone, F.md5(docs["text"]) == gone["__digest"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced at their places in every row, also in rows without a doc_id; every document stays."""
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; this stage alone has other columns."""
    return packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Training, latent search and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
