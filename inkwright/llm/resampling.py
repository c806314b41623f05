"""Importance resampling towards a target distribution.

Features are runs of up to `longest` words, hashed into buckets. A bucket's gain is the floored logarithm of how much likelier it is in
the target than in the corpus (smoothed by one); both counts cover all rows. Gains are an array of fixed size that goes to every
task, where a document's weight is a sum of looked-up gains. Gumbel noise from its doc_id makes the weight an integer
score whose highest ones are a weighted draw without replacement.

The draw needs no sort of all documents. A histogram of the exact scores is summed from the top, in two steps (spans of SPAN
scores, then scores within a span), so that every score knows the rank before its first row. The cutoff is the score in which
the quota ends; only rows at or above it are numbered, by doc_id within their score.

Null text, or text without words, has no features and weight 0. A null doc_id draws its noise from an empty name and comes
first among equals. Repeated rows are documents of their own with equal scores and ranks one after the other; they are counted
before they are numbered, so that one row repeated very often is no hot spot. Of rows with equal scores and ids the one with fewer features
comes first. An empty table gives an empty result, an empty target counts nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Gains and noise are floors of so many times a logarithm.
SCALE = 1000
#: Scores in a span of the histogram, and copies of a row that are numbered at once.
SPAN, COPIES = 1 << 12, 1 << 16
#: Bytes of a text that are split into words at once.
_SLICE = 1 << 20
#: Bytes as they count in words: A-Z lower-cased, every other ASCII byte that is no letter or digit a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of about _SLICE bytes that end where a word ends."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE) if len(data) - at > _SLICE else -1
        yield data[at : end if end >= 0 else len(data)]
        at = end if end >= 0 else len(data)


def hashed_features(text: str | None, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Bucket of every feature of a text, and the number of its words."""
    out, held, n = [np.empty(0, np.int64)], [], 0
    for part in _slices((text or "").encode().translate(_BYTES)):
        fresh = part.split()
        n += len(fresh)
        words = held + fresh
        for k in range(1, longest + 1):
            first = max(0, len(held) - k + 1)  # runs that end in words not seen before
            runs = words[first:] if k == 1 else [b" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1)]
            out.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets)
        held = words[len(words) - longest + 1 :] if longest > 1 else []
    return np.concatenate(out), n


def feature_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one row a bucket at most, the driver gets the sums."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(hashed_features(text.as_py(), longest, buckets)[0], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in the corpus and in the target."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.asarray([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id, an integer."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-SCALE) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @tidy
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found, n = hashed_features(text.as_py(), longest, len(gain))
                rows.append((n, len(found), int(gain[found].sum())))
            columns = np.asarray(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def offsets(scores: DataFrame) -> DataFrame:
    """score, n and `before`, the number of rows with higher scores, of every score that occurs."""
    counts = written(scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("score") / SPAN)), "scores")
    # One row a span: few, as scores are integers whose range follows the longest text, not the number of rows.
    down = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("span").agg(F.sum("n").alias("m")).select("span", F.coalesce(F.sum("m").over(down), F.lit(0)).alias("above"))
    within = Window.partitionBy("span").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(spans, "span").select("score", "n", (F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add `rank`: 1, 2, 3 ... for the percentage of rows with enough words that is drawn, else null. `rows` as from scored(), written."""
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    eligible = rows.filter(F.col("n_words") >= least_words)
    scores = written(offsets(eligible), "offsets")
    quota = percent * (scores.agg(F.sum("n")).first()[0] or 0) // 100
    # The one score in which the quota ends; without any quota nothing reaches the cutoff.
    last = scores.filter((F.col("before") < quota) & (F.col("before") + F.col("n") >= quota)).first()
    reaches = (F.col("n_words") >= least_words) & (F.col("score") >= last["score"]) if last else F.lit(False)
    rest = rows.filter(~reaches).withColumn("rank", F.lit(None).cast("long"))
    alike = rows.filter(reaches).groupBy(*kept).agg(F.count("*").alias("copies"))
    placed = alike.join(scores.select("score", "before"), "score")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0)))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES))))
    rank = F.col("before") + F.col("block") * COPIES + F.col("k")
    return rest.unionByName(each.select(*kept, F.when(rank <= quota, rank).alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; those with a rank are the sample."""
    small_batches(docs.sparkSession)
    gain = gains(feature_counts(docs, longest, buckets), feature_counts(target, longest, buckets))
    return drawn(written(scored(docs, gain, longest, seed), "weights"), percent, least_words)
