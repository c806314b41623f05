"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled ones, never what is labelled clean as such. With the class
prior p, the risk of a linear classifier is  p R+(positive) + max(0, R-(unlabelled) - p R-(positive));
where the second part falls below zero, its gradient is reversed, so the classifier can't win by
pushing the estimate under what a risk can be. The prior is the share of toxic rows among all
labelled training rows.

Several numpy classifiers are fitted, each in its own task, leaving out another part of a bounded
sample (MAX_POSITIVE, MAX_UNLABELLED documents in all, the smallest by hash). Their averaged logit
is calibrated by the same risk on what was left out. Scoring reads every text in full.

Features are the distinct words of a text and the beginnings (5 to 7 bytes) of its longer words, hashed.

Null text and text without words get the score of the intercept. Labels with null, or for documents
that do not exist, are ignored; repeated labels count once (toxic if any says so). Rows that repeat a
doc_id lend the sample one of their texts, the smallest. Without
any confirmed toxic text every score is 0. Rows keep their own columns; repeated rows are
scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, tidy, written
from .hashing import NOT_ALNUM, Words, chunks, window

MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
BAGS, FEATURES, LEAST_TEXTS, LEAST_Z = 3, 1 << 20, 4, 2.0
PREFIXES = (5, 6, 7)
#: Strengths of the penalty on weights; the one with the least risk on what was left out is taken.
PENALTIES = (2e-4, 6e-4, 2e-3)
THRESHOLD = 0.7


def features(texts) -> Iterator[np.ndarray]:
    """The sorted distinct hashed words of each text, and the beginnings of longer words."""
    for _, raw in chunks(texts):
        words = Words(raw, NOT_ALNUM)
        hashes, owner = [words.hash], [words.text]
        for k in PREFIXES:
            longer = np.flatnonzero(words.end - words.start > k)
            hashes.append(window(words.sums, words.start[longer], words.start[longer] + k) ^ np.uint64(k))
            owner.append(words.text[longer])
        at = (np.concatenate(hashes) & np.uint64(FEATURES - 1)).astype(np.int64)
        both = np.unique(np.concatenate(owner).astype(np.int64) * FEATURES + at)
        cuts = np.searchsorted(both, np.arange(len(raw) + 1) * FEATURES)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield both[a:b] % FEATURES


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many texts each feature occurs."""
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(rows), 1024):
        total += np.bincount(np.concatenate(rows[at : at + 1024]), minlength=FEATURES)
    return total


class Sample:
    """Features of the texts that one classifier learns from, positives first, without those that tell nothing.

    A feature is kept if it is in LEAST_TEXTS texts or more and in at most nine tenths of all, and if its shares among
    positives and unlabelled texts differ by LEAST_Z standard errors. Rare features weigh more (log of the
    inverse share of texts), which also evens out step sizes.
    """

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]):
        self.n, self.size = len(positive), len(positive) + len(unlabelled)
        p, u = _counts(positive), _counts(unlabelled)
        often = p + u
        share = often / self.size
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(len(positive), 1) + 1 / max(len(unlabelled), 1)))
        apart = np.abs(p / max(len(positive), 1) - u / max(len(unlabelled), 1)) >= LEAST_Z * spread
        kept = (often >= LEAST_TEXTS) & (share <= 0.9) & apart
        self.names = np.flatnonzero(kept)
        self.scale = np.log(self.size / often[kept]) / np.log(self.size + 1)
        place = np.cumsum(kept, dtype=np.int64) - 1
        used = [place[r[kept[r]]] for r in (*positive, *unlabelled)]
        self.row = np.repeat(np.arange(self.size), [len(x) for x in used])
        self.col = np.concatenate(used) if used else np.empty(0, np.int64)
        self.value = self.scale[self.col]


def fit(sample: Sample, prior: float, steps: int = 200, rate: float = 0.1, l1: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """One classifier: features, weights and intercept, under the non-negative logistic risk."""
    row, col, value, n, k = sample.row, sample.col, sample.value, sample.n, len(sample.names)
    w, b = np.zeros(k), np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    is_p = np.arange(sample.size) < n
    share = np.where(is_p, 1 / max(n, 1), 1 / max(sample.size - n, 1))
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(row, weights=w[col] * value, minlength=sample.size) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        minus = np.logaddexp(0, z) * share  # loss as a negative
        rest = minus[~is_p].sum() - prior * minus[is_p].sum()
        g_rest = np.where(is_p, -prior, 1.0) * share * p
        g_plus = np.where(is_p, prior, 0.0) * share * (p - 1)
        g = g_plus + g_rest if rest >= 0 else -g_rest
        grad = np.append(np.bincount(col, weights=g[row] * value, minlength=k), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-3)
        change = step * (m / (1 - 0.9**t))
        w, b = w - change[:-1], b - change[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - step[:-1] * l1)
    used = w != 0
    return sample.names[used], (w * sample.scale)[used], float(b)


def calibrated(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, float]:
    """The least non-negative risk on texts that were left out of training, with the slope and shift of logits that have it."""
    if not len(positive) or not len(unlabelled):
        return 0.0, 1.0, 0.0

    def risk(a: float, c: float) -> float:
        p, u = np.clip(a * positive + c, -40, 40), np.clip(a * unlabelled + c, -40, 40)
        return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    return min((risk(a, c), a, float(c)) for a in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for c in np.arange(-4, 4.1, 0.25))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[np.ndarray, float] | None:
    """Weights of all hashed words and the intercept, from training rows of `labels` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    labels = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = labels.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if not prior:
        return None
    prior = min(prior, 0.9)
    order = F.xxhash64("doc_id", F.lit(seed))
    known = written(labels.filter("toxic > 0").select("doc_id").orderBy(order).limit(MAX_POSITIVE), "positive")
    # Unlabelled texts come from all documents whatever their labels, so that the prior holds for them.
    some = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(order).limit(MAX_UNLABELLED)
    kinds = known.withColumn("positive", F.lit(True)).unionByName(some.withColumn("positive", F.lit(False)))
    wanted = written(kinds.groupBy("doc_id").agg(F.collect_set("positive").alias("kinds")), "sample")  # bounded, so it is broadcast
    # One text for each doc_id, so that rows which repeat one do not enlarge the sample.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "kinds").agg(F.min("text").alias("text"))
    texts = texts.select(F.explode("kinds").alias("positive"), F.pmod(order, F.lit(BAGS)).cast("int").alias("part"), "text")

    @tidy
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["part", "positive"]].assign(words=[f.astype("<i4").tobytes() for f in features(batch["text"])])

    def fitted(bag: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((p, o, x) for p, o, x in zip(bag["positive"], bag["left_out"], bag["words"]))
        kinds, out = np.asarray([r[0] for r in rows], bool), np.asarray([r[1] for r in rows], bool)
        rows = [np.frombuffer(r[2], "<i4") for r in rows]
        inside = {k: [r for r, p, o in zip(rows, kinds, out) if p == k and not o] for k in (True, False)}
        left_out = [[r for r, p, o in zip(rows, kinds, out) if p == k and o] for k in (True, False)]
        sample, found = Sample(inside[True], inside[False]) if inside[True] else None, []
        for penalty in PENALTIES if inside[True] else ():
            names, weights, intercept = fit(sample, prior, l1=penalty)
            dense = np.zeros(FEATURES)
            dense[names] = weights
            z = [(np.asarray([dense[r].sum() for r in part]) + intercept).tobytes() for part in left_out]
            found.append((penalty, names.astype("<i8").tobytes(), weights.tobytes(), intercept, *z))
        del rows, inside, left_out, sample
        give_back()
        return pd.DataFrame(found, columns=["penalty", "names", "weights", "intercept", "p", "u"])

    # Each classifier leaves out another part of the sample.
    rows = texts.mapInPandas(hashed, "part int, positive boolean, words binary")
    rows = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1)))).withColumn("left_out", F.col("bag") == F.col("part"))
    models = rows.groupBy("bag").applyInPandas(fitted, "penalty double, names binary, weights binary, intercept double, p binary, u binary").collect()
    if not models:
        return None
    best = None
    for penalty in PENALTIES:
        some = [m for m in models if m["penalty"] == penalty]
        left_out = (np.concatenate([np.frombuffer(m[k]) for m in some]) for k in "pu")
        tried = (*calibrated(*left_out, prior), some)
        best = tried if best is None or tried[0] < best[0] else best
    _, slope, shift, some = best
    weights = np.zeros(FEATURES)
    for model in some:
        weights[np.frombuffer(model["names"], "<i8")] += np.frombuffer(model["weights"]) / len(some)
    return slope * weights, slope * sum(m["intercept"] for m in some) / len(some) + shift


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 in the column `name`, from the text alone."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, intercept = held.value
        for texts in batches:
            z = np.asarray([weights[f].sum() for f in features(texts)]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return docs.withColumn(name, score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
