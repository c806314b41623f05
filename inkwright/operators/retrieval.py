"""Exact vector, keyword and hybrid retrieval over chunks.

Ranking ties end with the id, so results do not depend on partitioning. A zero vector has cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .batches import tidy, vector_batches

#: Query vectors held by a task at once, and chunks scored against them at once.
QUERY_BLOCK, CHUNK_BLOCK = 1024, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + d) of the squared distance."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + d)


def top_k(chunks: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, post_filter: bool = False, threshold: float | None = None) -> DataFrame:
    """The k best chunks with rank and score. `where` filters before ranking, or after the cut with post_filter."""
    rows = chunks if where is None or post_filter else chunks.filter(where)
    held = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("score", cosine(F.col(vector), held)).orderBy(F.desc("score"), key).limit(k)
    best = best.filter(where) if post_filter and where is not None else best
    best = best.filter(F.col("score") >= threshold) if threshold is not None else best
    # At most k rows are left, so one window over them is small.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def batch_top_k(queries: DataFrame, chunks: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): every query against every chunk, in blocks of QUERY_BLOCK queries.

    Each task keeps its k best per query, so the only shuffle carries k rows per query and task. A worker holds scores of CHUNK_BLOCK chunks.
    """
    vector_batches(chunks.sparkSession)

    def search(ids: list, matrix: np.ndarray):
        norms = np.linalg.norm(matrix, axis=1)

        @tidy
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in (whole.iloc[a : a + CHUNK_BLOCK] for whole in batches for a in range(0, len(whole), CHUNK_BLOCK)):
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                size = np.outer(norms, np.linalg.norm(x, axis=1))
                score = np.divide(matrix @ x.T, size, out=np.zeros_like(size), where=size > 0)
                keys = batch[key].to_numpy()
                least = np.partition(score, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(ids), -np.inf)
                q, c = np.nonzero(score >= least[:, None])  # ties with the k-th best stay until keys decide
                part = pd.DataFrame({"query_id": np.asarray(ids)[q], key: keys[c], "score": score[q, c]})
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        return run

    out, kind = None, dict(chunks.dtypes)[key]

    def with_block(out: DataFrame | None, rows: list) -> DataFrame:
        matrix = np.asarray([r[vector] for r in rows], np.float64)
        found = chunks.select(key, vector).mapInPandas(search([r[key] for r in rows], matrix), f"query_id {kind}, {key} {kind}, score double")
        return found if out is None else out.unionByName(found)

    held = []
    for row in queries.select(key, vector).orderBy(key).toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            out, held = with_block(out, held), []
    if held:
        out = with_block(out, held)
    if out is None:
        return chunks.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def keyword_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, mean_length: float = 100.0) -> DataFrame:
    """(key, score): term saturation with a fixed mean length and no document frequencies; repeated query terms count again."""
    terms = docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]
    found = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    score = F.lit(0.0)
    for term in terms:
        tf = F.size("terms") - F.size(F.array_remove("terms", term))
        score = score + F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean_length))).otherwise(0.0)
    return found.select(key, score.alias("score"))


def hybrid_top_k(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, alpha: float = 0.7, key: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """Both sides, each divided by its best score, weighted and added; a missing side counts 0. `hits` hold at most 2k rows."""
    alpha = max(0.0, min(1.0, alpha))

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        top = F.max("score").over(Window.partitionBy(F.lit(1)))
        return hits.select(key, F.when(top > 0, F.col("score") / top).otherwise(0.0).alias(name))

    both = scaled(vector_hits, "v").join(scaled(keyword_hits, "w"), key, "full_outer")
    total = F.coalesce("v", F.lit(0.0)) * alpha + F.coalesce("w", F.lit(0.0)) * (1 - alpha)
    best = both.select(key, total.alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def hash_vector(text: Column, size: int = 384) -> Column:
    """A unit vector that depends on the text alone: the fallback where no embedding model is given."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.md5((t or "").encode()).digest()[:4], "big")
            v = np.random.RandomState(seed).randn(size)
            out.append((v / np.linalg.norm(v)).tolist())
        return pd.Series(out)

    return vectors(text)


def basic_answer(chunks: Column, sources: Column) -> Column:
    """The first three chunks, cut to 300 characters, with their sources."""
    return F.array_join(F.transform(F.slice(F.arrays_zip(chunks.alias("c"), sources.alias("s")), 1, 3), lambda x: F.concat(F.lit("["), x["s"], F.lit("] "), F.substring(x["c"], 1, 300))), "\n\n")


def answered(questions: DataFrame, chunks: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", text: str = "text", source: str = "source") -> DataFrame:
    """(query_id, answer, confidence, sources, context): the k best chunks of each question, a basic answer from them, the mean of their scores.

    `context` is all of their texts in order. A question without chunks gives no row.
    """
    hits = batch_top_k(questions, chunks, k, key, vector).join(chunks.select(key, F.coalesce(text, F.lit("")).alias("_t"), F.coalesce(source, F.lit("")).alias("_s")), key)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("_k"), "_t", "_s")))
    rows = hits.groupBy("query_id").agg(ordered.alias("_h"), F.avg("score").alias("confidence"))
    pick = lambda c: F.transform("_h", lambda h: h[c])
    return rows.select("query_id", basic_answer(pick("_t"), pick("_s")).alias("answer"), "confidence", pick("_k").alias("sources"), F.array_join(pick("_t"), "\n\n").alias("context"))
