"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph pieces.

A text's paragraphs (lines) are cut after every PIECE_WORDS words; each piece, with the number of times
it has occurred before, has a 64-bit digest. A sketch adds every digest to three of its cells, each
cell a count, a sum of digests and a sum of check values. Subtracting the sketches of two versions
leaves the digests in which they differ; peeling cells that hold a single one recovers those. Where
peeling gets stuck, both are sketched again in four times the cells. Likeness is the
Jaccard coefficient of the two sets of digests, from the recovered difference and the two sizes.

The fingerprint is the sketch of BASE_CELLS cells with the number of digests, in base64: equal texts have equal ones. `likeness` compares two
stored fingerprints: it subtracts and peels them, and is None where that gets stuck, so a holder of the column can tell near texts without
the texts. The query takes that value first; only pairs without one are sketched again, larger, from their texts.

Versions here are a text and its edit: its last third comes from the next document in descending doc_id.
Neighbours meet by ranges of doc_id; an id with more rows than a range should hold is cut into several by the digests of its texts. A copy of
the first row of each range goes to the range before it, so no task sees more than its range and one row.

Null text is empty; two empty texts have likeness 1. Null doc_ids come last in the order. Documents with
equal doc_id follow one another in the order of digests of their texts. A single document is its own next. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import partitions, small_batches, written
from .hashing import SPACES, Words, mixed, window

PIECE_WORDS, BASE_CELLS, GROWTH, HASHES = 8, 16, 4, 3
#: Null ids are ordered as the least one.
_LEAST = -(1 << 63)
_CHECK = np.uint64(0xA0761D6478BD642F)
#: Check values are compared and kept in so many bits.
_LOW = np.uint64(0xFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u4")])
_SEEDS = [np.uint64((k + 1) * int(_CHECK) % (1 << 64)) for k in range(HASHES)]


def piece_digests(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every piece; digests of one text are distinct."""
    words = Words(raw, SPACES, lower=False)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    line = np.searchsorted(np.flatnonzero(data == 10), words.start)
    fresh = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(line)) - np.repeat(fresh, np.diff(np.append(fresh, len(line))))
    begin = np.flatnonzero(place % PIECE_WORDS == 0)
    last = np.append(begin[1:], len(line)) - 1
    text, digest = words.text[begin], window(words.sums, words.start[begin], words.end[last])
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.append(True, (text[1:] != text[:-1]) | (digest[1:] != digest[:-1]))
    starts = np.flatnonzero(new)
    times = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    return text.astype(np.int64), mixed(digest + times.astype(np.uint64) * _STEP)


class Sketches:
    """Sketches of several sets, one row of cells for each."""

    def __init__(self, sets: int, cells: int):
        self.sets, self.cells = sets, cells
        self.count = np.zeros(sets * cells, np.int64)
        self.sum, self.check = np.zeros(sets * cells, np.uint64), np.zeros(sets * cells, np.uint64)

    def places(self, owner: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
        """A cell in each of HASHES equal parts of the row, apart from the remainder."""
        part = self.cells // HASHES
        return [owner * self.cells + k * part + (mixed(digest + seed) % np.uint64(part)).astype(np.int64) for k, seed in enumerate(_SEEDS)]

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
        check = mixed(digest ^ _CHECK)
        wrap = sign.astype(np.uint64)
        for at in self.places(owner, digest):
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, digest * wrap)
            np.add.at(self.check, at, check * wrap)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, digest, sign) of all digests recovered, and whether each set gave all of its own. Empties the cells."""
        found = []
        for _ in range(4 * self.cells):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            digest = self.sum[at] * sign.astype(np.uint64)
            pure = (mixed(digest ^ _CHECK) * sign.astype(np.uint64) - self.check[at]) & _LOW == 0
            owner, digest, sign = (at // self.cells)[pure], digest[pure], sign[pure]
            if not len(owner):
                break
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], sign[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1]))
            owner, digest, sign = owner[new], digest[new], sign[new]
            found.append((owner, digest, sign))
            self.add(owner, digest, -sign)
        rest = (self.count != 0) | (self.sum != 0) | (self.check & _LOW != 0)
        none = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
        return *(np.concatenate(c) for c in zip(none, *found)), ~rest.reshape(self.sets, self.cells).any(axis=1)

    def minus(self, pairs: np.ndarray) -> Sketches:
        """Sketches of the differences of pairs of sets."""
        out = Sketches(len(pairs), self.cells)
        for name in ("count", "sum", "check"):
            rows = getattr(self, name).reshape(self.sets, self.cells)
            getattr(out, name)[:] = (rows[pairs[:, 0]] - rows[pairs[:, 1]]).reshape(-1)
        return out

    def strings(self, sizes: np.ndarray) -> list[str]:
        rows = np.empty(self.sets * self.cells, _CELL)
        rows["count"], rows["sum"], rows["check"] = self.count, self.sum, self.check & _LOW
        return [f"{n}:{base64.b64encode(r.tobytes()).decode()}" for n, r in zip(sizes, rows.reshape(self.sets, self.cells))]


def _alike(sizes: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Jaccard coefficients from the sizes of two sets together and the number of digests that only one has."""
    return np.where(sizes + gone > 0, (sizes - gone) / np.maximum(sizes + gone, 1), 1.0)


def likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two fingerprints; None if either is null or their difference is too large for their cells."""
    if a is None or b is None:
        return None
    (n, x), (m, y) = ((int(size), np.frombuffer(base64.b64decode(cells), _CELL)) for size, cells in (t.split(":") for t in (a, b)))
    sketch = Sketches(1, len(x))
    sketch.count[:] = x["count"].astype(np.int64) - y["count"]
    sketch.sum[:] = x["sum"] - y["sum"]
    sketch.check[:] = x["check"].astype(np.uint64) - y["check"].astype(np.uint64)
    found = sketch.peel()
    return float(_alike(np.asarray([n + m]), np.asarray([len(found[1])]))[0]) if found[3][0] else None


@F.pandas_udf(DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """`likeness` of two columns of fingerprints."""
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def differences(owner: np.ndarray, digest: np.ndarray, pairs: np.ndarray, sets: int, base: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of every digest that one set of a pair has and the other has not, by subtraction and peeling.

    The sign is 1 for a digest of the first set and -1 for one of the second. `base` has the sets' sketches of BASE_CELLS cells, if they are made already.
    """
    first = np.searchsorted(owner, np.arange(sets + 1))
    if base is None:
        base = Sketches(sets, BASE_CELLS)
        base.add(owner, digest, np.ones(len(owner), np.int64))
    sketch, out, left, cells = base.minus(pairs), [], np.arange(len(pairs)), BASE_CELLS
    while len(left):
        at, value, sign, whole = sketch.peel()
        kept = whole[at]
        out.append((left[at[kept]], value[kept], sign[kept]))
        left, cells = left[~whole], cells * GROWTH
        sketch = Sketches(len(left), cells)
        for side, sign in ((0, 1), (1, -1)):
            begin, end = first[pairs[left, side]], first[pairs[left, side] + 1]
            take = np.repeat(begin - np.append(0, np.cumsum(end - begin)[:-1]), end - begin) + np.arange((end - begin).sum())
            sketch.add(np.repeat(np.arange(len(left)), end - begin), digest[take], np.full(len(take), sign, np.int64))
    none = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(none, *out))


def differing_digests(old: str | None, new: str | None) -> tuple[list[int], list[int]]:
    """Digests of the pieces that only the old text has, and of those that only the new one has, in ascending order."""
    owner, digest = piece_digests([(old or "").encode(), (new or "").encode()])
    _, value, sign = differences(owner, digest, np.asarray([[0, 1]]), 2)
    return sorted(value[sign > 0].tolist()), sorted(value[sign < 0].tolist())


def compared(texts: list[str], following: list[int]) -> list[tuple]:
    """The result columns for texts[k], edited by texts[following[k]], for every k that has a following text."""
    edited = []
    for k, nxt in enumerate(following):
        text, third = texts[k], len(texts[k]) // 3
        edited.append(text[: len(text) - third] + texts[nxt][:third])
    raw = [t.encode() for t in texts] + [t.encode() for t in edited]
    owner, digest = piece_digests(raw)
    n, m = len(following), len(raw)
    sizes = np.bincount(owner, minlength=m)
    base = Sketches(m, BASE_CELLS)
    base.add(owner, digest, np.ones(len(owner), np.int64))
    prints = base.strings(sizes)
    pairs = np.asarray([(k, len(texts) + k) for k in range(n)] + list(enumerate(following)), np.int64).reshape(-1, 2)
    gone = np.bincount(differences(owner, digest, pairs, m, base)[0], minlength=len(pairs))
    near = _alike(sizes[pairs[:, 0]] + sizes[pairs[:, 1]], gone)
    return [(len(texts[k]), hashlib.sha256(raw[len(texts) + k]).hexdigest(), prints[k], prints[len(texts) + k], float(near[k]), float(near[n + k])) for k in range(n)]


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(edges, middle) < value
        return F.when(s["low"] < s["high"], F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))).otherwise(s)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda s: s["low"])


def with_following(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges and sorted downwards by doc_id; `ahead` marks a copy of the next range's first row.

    A range holds some ids, or a part, by the digests of their texts, of the rows of one id that has too many for one.
    """
    n = partitions(docs.sparkSession)
    least, place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = docs.select(least.alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", place + F.when(F.col("null_id"), F.lit(1 << 62)).otherwise(F.lit(0)))
    total, cuts = docs.select(F.count("*"), F.percentile_approx(least, [k / n for k in range(1, n)] or [0.5], 10_000)).first()
    if not total:
        return rows.withColumns({"range": F.lit(0), "ahead": F.lit(False)})
    most = -(-total // n)
    # Fewer than n ids have more rows than a range should hold; each has ranges of its own.
    heavy = {r["doc_id"]: -(-r["n"] // most) for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * most).collect()}
    bounds = sorted({*cuts[: n - 1], *heavy, *(i - 1 for i in heavy if i > _LEAST)})
    parts = [heavy.get(b, 1) for b in bounds] + [1]
    held = [2 * p if p > 1 and b == _LEAST else p for b, p in zip([*bounds, None], parts)]  # digests of null ids come after all others
    first = [sum(held[:k]) for k in range(len(held))]
    part, last, below = (F.get(F.array(*map(F.lit, x)), F.col("of")) for x in (parts, [h - 1 for h in held], first))
    down = below + last - F.least(F.floor(F.col("digest") / float(1 << 62) * part).cast("int"), last)
    keyed = rows.withColumn("of", _range_of(F.col("doc_id"), bounds)).withColumn("range", down).drop("of")
    # The place of each range's first row; there are at most a few ranges a partition.
    tops = keyed.groupBy("range").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("d"), "digest")).alias("top"))
    tops = written(tops.select("range", F.bitwise_not("top.d").alias("doc_id"), "top.digest"), "tops")
    filled = sorted(r["range"] for r in tops.select("range").collect())
    above = dict(zip(filled, [*filled[1:], filled[0]]))  # the last document's next is the first of all
    sent = F.get(F.array(*[F.lit(above.get(k, 0)) for k in range(sum(held))]), F.col("range"))
    copies = keyed.join(F.broadcast(tops), ["range", "doc_id", "digest"]).groupBy("range", "doc_id", "null_id", "digest").agg(F.min("text").alias("text"))
    copies = copies.withColumns({"ahead": F.lit(True), "range": sent})
    both = keyed.withColumn("ahead", F.lit(False)).unionByName(copies)
    return both.repartitionById(sum(held), F.col("range")).sortWithinPartitions("range", "ahead", F.desc("doc_id"), "digest", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the two fingerprints and the two likenesses of every document."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(ids: list[int | None], texts: list[str], following: list[int]) -> pd.DataFrame:
        rows = [(i, *r) for i, r in zip(ids, compared(texts, following))]
        frame = pd.DataFrame(rows, columns=names)
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    def process(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, held, done = [], [], 0, None, False  # texts[k + 1] follows texts[k]; the last waits for its next
        for batch in batches:
            for part, ahead, doc_id, null, text in zip(batch["range"], batch["ahead"], batch["doc_id"], batch["null_id"], batch["text"]):
                if part != held:
                    ids, texts, size, held, done = [], [], 0, part, False
                if done:
                    continue
                if ahead:
                    if texts:
                        yield result(ids, [*texts, text], list(range(1, len(texts) + 1)))
                    ids, texts, size, done = [], [], 0, True
                    continue
                if size > 1 << 20:
                    yield result(ids, [*texts, text], list(range(1, len(texts) + 1)))
                    ids, texts, size = [], [], 0
                ids.append(None if null else int(doc_id))
                texts.append(text)
                size += len(text)

    return with_following(docs).mapInPandas(process, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
