"""An inverted-list vector index: k-means lists trained on a sample, vectors in a table partitioned by list, exact scores in the lists probed.

* Lists are trained by k-means on at most `sample` vectors, those whose ids hash lowest; every vector of the table is indexed.
* A query reads its `probes` nearest lists only. Lists that no query needs are pruned from the scan; queries and vectors meet as blocks
  of a list, so neither side goes through the driver and a long list is many blocks.
* Scores are exact cosines; with all lists probed the result is that of an exhaustive search.
* `probes_for` finds how many lists a wanted recall takes, from sample queries searched exhaustively.

A null vector or a null id is not indexed. A zero vector has cosine 0 to everything. Repeated ids are hits of their own. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import tidy, vector_batches
from .retrieval import batch_top_k

LISTS, SAMPLE, ROUNDS, SEED = 100, 50_000, 8, 17
#: Vectors, or queries, of a block; sample queries for the recall.
BLOCK, SAMPLE_QUERIES = 512, 200
#: Rows of a query and a list that leave a worker in one batch.
OUT_ROWS = 4_096


@dataclass(frozen=True)
class VectorIndex:
    """A written index: `path` holds the vectors by list; the centroids, at most LISTS rows, are kept here."""

    path: str
    key: str
    vector: str
    centroids: np.ndarray
    schema: StructType

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _unit_column(vector: str) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(size > 0, v / size).otherwise(0.0))


def build(chunks: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> VectorIndex:
    """Train the lists and write every vector to the list whose centroid is nearest."""
    rows = chunks.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    taken = rows.orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(_unit_column(vector)).alias("features"))
    if taken.isEmpty():
        none = rows.withColumn("list", F.lit(0))
        none.write.partitionBy("list").parquet(path)
        return VectorIndex(path, key, vector, np.zeros((0, 1)), none.schema)
    model = KMeans(k=lists, maxIter=ROUNDS, seed=seed, predictionCol="list").fit(taken)
    placed = model.transform(rows.withColumn("features", array_to_vector(_unit_column(vector)))).drop("features")
    placed.write.partitionBy("list").parquet(path)
    return VectorIndex(path, key, vector, np.asarray(model.clusterCenters()), placed.schema)


def nearest_lists(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """Queries with `list` and `place`, one row for each of their nearest lists."""
    held = queries.sparkSession.sparkContext.broadcast(index.centroids)
    wanted = len(index.centroids) if probes is None else min(probes, len(index.centroids))

    vector_batches(queries.sparkSession)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        some = max(1, OUT_ROWS // max(1, wanted))
        for batch in (whole.iloc[a : a + some] for whole in batches for a in range(0, len(whole), some)):
            if wanted:
                x = _unit(np.stack(batch[index.vector].to_numpy()).astype(np.float64))
                order = np.argsort((c * c).sum(axis=1) - 2 * x @ c.T, axis=1, kind="stable")[:, :wanted]
                out = batch.loc[batch.index.repeat(wanted)].reset_index(drop=True)
                yield out.assign(list=order.reshape(-1), place=np.tile(np.arange(wanted), len(batch)))

    rows = queries.filter(F.col(index.vector).isNotNull()).select(index.key, index.vector)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"{index.key} {kinds[index.key]}, {index.vector} {kinds[index.vector]}, list int, place int")


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(list, keys, matrix): vectors of one list, BLOCK at most, as they come."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("list"):
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    matrix = np.stack(some[vector].to_numpy()).astype("<f8")
                    yield pd.DataFrame({"list": [number], "keys": [some[key].tolist()], "matrix": [matrix.tobytes()]})

    return rows.select("list", key, vector).mapInPandas(run, f"list int, keys array<{kind}>, matrix binary")


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best of the lists that each query probes; all lists without `probes`."""
    spark, key = queries.sparkSession, index.key
    near = nearest_lists(queries, index, probes)
    wanted = [r["list"] for r in near.select("list").distinct().collect()]  # at most as many as there are lists
    vectors = index.vectors(spark).filter(F.col("list").isin(wanted))
    kind = dict(queries.dtypes)[key]
    asked = _blocks(near, key, index.vector).select("list", F.col("keys").alias("query_ids"), F.col("matrix").alias("queries"))
    vector_batches(spark)
    met = _blocks(vectors, key, index.vector).join(asked, "list").select("query_ids", "queries", "keys", "matrix")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a few blocks at a time, by their bytes
            for ids, asked, keys, held in zip(batch["query_ids"], batch["queries"], batch["keys"], batch["matrix"]):
                q, x = (_unit(np.frombuffer(m, "<f8").reshape(n, -1)) for m, n in ((asked, len(ids)), (held, len(keys))))
                score = q @ x.T
                least = np.partition(score, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(ids), -np.inf)
                a, b = np.nonzero(score >= least[:, None])  # ties with the k-th best stay until ids decide
                yield pd.DataFrame({"query_id": np.asarray(ids)[a], key: np.asarray(keys)[b], "score": score[a, b]})

    found = met.mapInPandas(run, f"query_id {kind}, {key} {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, neighbours, found and recall of a search against an exhaustive one."""
    hit = found.select("query_id", key).withColumn("hit", F.lit(1))
    both = exact.select("query_id", key).join(hit, ["query_id", key], "left")
    out = both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.greatest(F.col("neighbours"), F.lit(1)))


def probes_for(index: VectorIndex, queries: DataFrame, k: int, wanted: float = 0.95) -> int:
    """Least number of lists with which SAMPLE_QUERIES of the queries (least by hash) find the wanted share of their true k neighbours."""
    spark, key = queries.sparkSession, index.key
    some = queries.orderBy(F.xxhash64(key), key).limit(SAMPLE_QUERIES)
    exact = batch_top_k(some, index.vectors(spark), k, key, index.vector).select("query_id", key)
    lists = index.vectors(spark).select(key, "list").join(F.broadcast(exact), key)  # k rows for each sample query
    places = nearest_lists(some, index).select(F.col(key).alias("query_id"), "list", "place")
    counts = {r["place"]: r["n"] for r in lists.join(F.broadcast(places), ["query_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).collect()}
    seen, total = 0, sum(counts.values())
    for place in range(len(index.centroids)):
        seen += counts.get(place, 0)
        if seen >= wanted * total:
            return place + 1
    return max(1, len(index.centroids))
