"""The queries of this subpackage, by name, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import chains, conversations, digests
from .common import table
from .decontamination import leaks
from .fingerprints import fingerprints
from .manifest import document_manifest
from .ngram_join import linked_documents
from .packing import packed_documents
from .quality import quality_verdicts
from .resampling import resampled
from .secrets import secret_findings
from .sharding import sharded
from .suffix_dedup import deduplicated
from .token_files import token_files
from .tokens import tokenizer_path
from .toxicity import toxicity


#: A conversation whose texts hold the template's own marks, formatted with the table's.
MARKS = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], turns.schema)
    return digests(conversations(chains(turns.unionByName(marks))))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "finding", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), 40)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return document_manifest(table(spark, sf_dir, "documents"), tampered=hit)


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_formatting, op2_secret_scan, op3_token_files, op4_toxicity, op5_best_fit_packing, op6_jump_sharding, op7_ngram_jaccard_join, op8_fingerprints, op9_suffix_array_dedup, op10_benchmark_decontamination, op11_quality_rules, op12_importance_resampling, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": sql.chat_formatting(MARKS), "op7_ngram_jaccard_join": sql.JACCARD_JOIN, "op9_suffix_array_dedup": sql.SUFFIX_DEDUP, "op11_quality_rules": sql.quality_rules(), "op12_importance_resampling": sql.IMPORTANCE_RESAMPLING, "op13_merkle_manifest": sql.MERKLE_MANIFEST}
