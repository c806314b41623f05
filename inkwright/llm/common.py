"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.batches import BATCH_BYTES, BATCH_ROWS, give_back, small_batches, tidy
from .hashing import mixed

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "FILTER_BITS", "give_back", "id_filter", "may_hold", "partitions", "release", "scratch", "small_batches", "table", "tidy", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares; a temporary one only if none is set, on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; else they stay until the
    driver happens to collect its garbage. What just ended may still be referred to, so it is asked twice."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


#: Bits of an id filter, 2 MB whatever the number of ids.
FILTER_BITS, _FILTER_BLOCKS = 1 << 24, 8


def _filter_places(ids: np.ndarray) -> np.ndarray:
    return (mixed(np.asarray(ids, np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits set for every id of the only column; what lets most other rows be passed over before a join.

    Its size is fixed, so it can be sent to all tasks. With very many ids it passes everything: the join after
    it stays right and only reads more.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_places(batch.iloc[:, 0].to_numpy())] = True
        packed = np.packbits(bits).reshape(_FILTER_BLOCKS, -1)
        kept = [k for k in range(_FILTER_BLOCKS) if packed[k].any()]
        yield pd.DataFrame({"block": kept, "bits": [zlib.compress(packed[k].tobytes(), 1) for k in kept]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"block": rows["block"][:1], "bits": [zlib.compress(bits.tobytes(), 1)]})

    out = np.zeros((_FILTER_BLOCKS, FILTER_BITS // 8 // _FILTER_BLOCKS), np.uint8)
    for row in ids.mapInPandas(part, "block int, bits binary").groupBy("block").applyInPandas(merged, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _filter_places(ids)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
