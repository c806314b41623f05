"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths, at most
`capacity` entries whatever the corpus, goes to the driver. There best-fit decreasing runs over counts: equal
open sequences are handled together, so the plan's size follows the number of different lengths,
not of documents. The plan is a table of slot intervals; pieces are ranked within their length
and take the slot with their rank by a join.

Null text is an empty document, one piece holding the end id. Repeated rows are documents of
their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written
from .tokens import END_ID, encoder

CAPACITY = 4096
#: Ranks are joined to slot intervals within blocks of this many ranks.
BLOCK = 64
_SPAN = 1 << 15
#: Parts that a key's rows are numbered in: so many at least, and one for every _PART_ROWS rows of the largest key.
_SALTS, _PART_ROWS = 64, 200_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    small_batches(docs.sparkSession)
    end = np.asarray([END_ID], "<u4").tobytes()

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], enc.encode_all(batch["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) intervals.

    Open sequences with equal free space form groups (first, count). A group takes as many pieces
    of the length as fit into each sequence, one sequence after the other, just as best-fit does one by one.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, count: int, space: int, each: int) -> None:
            nonlocal rank, left
            for k in range(each):
                slots.append((length, rank, count, first, capacity - space + k * length))
                rank += count
            left -= each * count
            free.setdefault(space - each * length, []).append((first, count))

        for space in sorted(s for s in free if s >= length):
            while left and free.get(space):
                first, count = free[space].pop()
                each = space // length
                whole = min(count, left // each)
                if whole:
                    fill(first, whole, space, each)
                if whole < count and 0 < left < each:
                    fill(first + whole, 1, space, left)
                    whole += 1
                if whole < count:
                    free[space].append((first + whole, count - whole))
                    if not left:
                        break
            if not left:
                break
        each = capacity // length
        if whole := left // each:
            fill(opened, whole, capacity, each)
            opened += whole
        if left:
            fill(opened, 1, capacity, left)
            opened += 1
    return slots


def ranked(df: DataFrame, key: str, order: list[str], name: str, most: int) -> DataFrame:
    """Number rows 0, 1, ... within `key`, also where one key holds much of the table; `most`: rows of the largest key.

    Rows are numbered within (key, salt), and the number of rows in earlier salts is added.
    """
    salts = max(_SALTS, most // _PART_ROWS)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")
    counts = counts.select(F.col(key).alias("_k"), F.col("_salt").alias("_s"), before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    rows = salted.withColumn("_in", inner.cast("long"))
    joined = rows.join(counts, rows[key].eqNullSafe(counts["_k"]) & (rows["_salt"] == counts["_s"]))
    return joined.withColumn(name, F.col("_in") + F.col("_before")).drop("_salt", "_k", "_s", "_before", "_in")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; `parts` is read three times, so give a written table."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    columns = np.asarray(plan(histogram, capacity), "int64").reshape(-1, 5).T
    slots = spark.createDataFrame(pa.table(list(columns), names=["p_length", "first", "n", "base", "at"]))
    # Blocks of ranks that an interval touches, in two steps so that no array grows with the corpus.
    low, high = F.expr(f"first div {BLOCK}"), F.expr(f"(first + n - 1) div {BLOCK}")
    slots = slots.withColumn("span", F.explode(F.sequence(F.expr(f"first div {BLOCK * _SPAN}"), F.expr(f"(first + n - 1) div {BLOCK * _SPAN}"))))
    slots = slots.withColumn("block", F.explode(F.sequence(F.greatest(low, F.col("span") * _SPAN), F.least(high, F.col("span") * _SPAN + _SPAN - 1))))
    rows = ranked(parts, "length", ["doc_id", "piece", "ids_crc32", "start"], "rank", max(histogram.values(), default=0)).withColumn("r_block", F.expr(f"rank div {BLOCK}"))
    found = rows.join(slots, (rows["length"] == slots["p_length"]) & (rows["r_block"] == slots["block"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
