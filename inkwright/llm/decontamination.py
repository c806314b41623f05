"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words, a new one every STRIDE words, over every whole text. In the
space of the benchmark's own words they have TF-IDF weights; document frequencies come from all passages.
A distributed randomised SVD of TF-IDF passages (the items and all windows of the corpus, whose counted terms are
written once and read in three rounds) gives a basis of at most RANK latent dimensions. Every passage of the corpus is projected and compared with
every item by cosine; an item of more than WINDOW words counts with the nearest of itself and its own passages, one
every PIECE words. Those at COSINE or more are checked on the words up to 1.25 item lengths around them: the longest
common subsequence with the item in its best stretch of 1.25 item lengths, and the share of the answer's words
there (the `answer` column, else the item's last sentence). Only an `answer` column decides: without one
answer_share is told, but a last sentence that was changed or cut off does not clear a text.

The benchmark is a stated query set. It is taken in blocks of BLOCK_ITEMS items and passages with a basis each, so that a
block's items stay apart in the latent space. PASS_BLOCKS blocks share one count and one search of the corpus; no more
are held at once.

Items or texts that are null or without words match nothing; an item with a null id is skipped. Every row has its own results, one for
each item found in it: rows that repeat an id, or have none, are not taken for one document. An id keeps its type, so a digest of the
text may stand for it. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, written
from .hashing import NOT_ALNUM, Words, chunks

PIECE = 16
WINDOW, STRIDE = 4 * PIECE, 2 * PIECE
RANK, OVERSAMPLE, BLOCK_ITEMS, PASS_BLOCKS = 96, 8, 256, 16
#: Windows whose terms meet a matrix at once; numbers of a partial sum that travel in one row.
_ROWS, _PART = 512, 1 << 16
COSINE, LCS_SHARE, ANSWER_SHARE = 0.6, 0.6, 0.6
_RESULT = "item_id long, start_word long, cosine double, lcs_share double, answer_share double"


def _words(text: str | None) -> np.ndarray:
    return Words([(text or "").lower().encode()], NOT_ALNUM).hash


def _lower(texts: pd.Series) -> Iterator[str]:
    return (t.lower() for t in texts)


def _parts(item: np.ndarray) -> list[np.ndarray]:
    """The item and, if it is longer than a passage, its own passages."""
    last = len(item) - WINDOW
    return [item] + [item[a : a + WINDOW] for a in [*range(0, last, PIECE), last] if last > 0]


class Block:
    """Items of a block with their vocabulary; what executors need, of a size bounded by BLOCK_ITEMS items."""

    def __init__(self, rows: list, least_answer: float):
        self.least_answer = least_answer
        self.ids = [r["item_id"] for r in rows]
        self.items = [_words(r["text"]) for r in rows]
        self.answers = [_words(r["answer"]) for r in rows]
        self.vocabulary = np.unique(np.concatenate(self.items))
        parts = [_parts(x) for x in self.items]
        self.queries = [q for x in parts for q in x]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])  # first query of each item

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1."""
        return _places(self.vocabulary, words)


def _places(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _passages(first: np.ndarray, pieces_in: int) -> tuple[np.ndarray, np.ndarray]:
    """First piece and number of pieces of every passage; `first`: first piece of each text, then the end."""
    begin, count = [], []
    for a, b in zip(first[:-1], first[1:]):
        starts = np.arange(a, max(a + 1, b - STRIDE // PIECE), STRIDE // PIECE)[: max(0, b - a)]
        begin.append(starts)
        count.append(np.minimum(pieces_in, b - starts))
    return np.concatenate(begin), np.concatenate(count)


class Chunk:
    """Words of a chunk of texts, in pieces of PIECE words that never cross texts."""

    def __init__(self, raw: list[bytes]):
        words = Words(raw, NOT_ALNUM)
        self.hash, self.first = words.hash, words.first
        starts = [np.arange(a, b, PIECE) for a, b in zip(words.first[:-1], words.first[1:])]
        self.piece = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.of_text = np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, int]:
        """For each word its whole window (these do not overlap), and their number."""
        text = np.searchsorted(self.first, np.arange(len(self.hash)), "right") - 1
        fresh = (np.arange(len(self.hash)) - self.first[text]) % WINDOW == 0
        return np.cumsum(fresh) - 1, int(fresh.sum())

    def counted(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Distinct terms of the windows one after the other, how often each occurs there, its window, and the number of windows."""
        passage, n = self.windows()
        term = _places(vocabulary, self.hash)
        known = np.flatnonzero(term >= 0)
        both, times = np.unique(passage[known] * len(vocabulary) + term[known], return_counts=True)
        return both % len(vocabulary), times, both // len(vocabulary), n

    def projected(self, term: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of all passages, scaled to length 1, and the first piece of each; basis: one row per term, weighted."""
        begin, count = _passages(self.of_text, WINDOW // PIECE)
        if not len(begin):
            return np.empty((0, basis.shape[1]), np.float32), begin
        padded = np.vstack([basis, np.zeros((1, basis.shape[1]), basis.dtype)])
        sums = np.empty((len(self.piece) + WINDOW // PIECE, basis.shape[1]), np.float32)
        sums[len(self.piece) :] = 0
        edges = np.append(self.piece, len(self.hash))
        for a in range(0, len(self.piece), 512):  # a few thousand word vectors at a time
            b = min(a + 512, len(self.piece))
            lo, hi = edges[a], edges[b]
            sums[a:b] = np.add.reduceat(padded[term[lo:hi]], edges[a:b] - lo, axis=0)
        out = np.zeros((len(begin), basis.shape[1]), np.float32)
        for k in range(WINDOW // PIECE):
            out += np.where((count > k)[:, None], sums[begin + k], 0)
        out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
        return out, begin


def _lcs(x: np.ndarray, y: np.ndarray) -> int:
    row = np.zeros(len(y) + 1, np.int64)
    for value in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == value)))
    return int(row[-1])


def checked(words: np.ndarray, item: np.ndarray, answer: np.ndarray) -> tuple[int, float, float]:
    """Start of the best stretch of 1.25 item lengths, the share of the item's subsequence there, the answer's share.

    A stretch has no longer subsequence than words of the item, nor one longer than another stretch's and the
    words between their starts; only stretches that may still beat the best one are looked at.
    """
    length = min(len(words), -(-5 * len(item) // 4))
    known = np.sort(item)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    sums = np.concatenate([[0], np.cumsum(known[place] == words)])
    here = sums[length:] - sums[:-length] if length else np.zeros(1, np.int64)
    most, at, best = here.astype(np.int64), int(np.argmax(here)), -1
    while most.max() > best and most.max() >= LCS_SHARE * len(item):
        start = int(np.argmax(most))
        found = _lcs(item, words[start : start + length])
        if found > best:
            at, best = start, found
        most = np.minimum(most, found + np.abs(np.arange(len(most)) - start))
    if best < LCS_SHARE * len(item):
        return at, 0.0, 0.0
    part = words[at : at + length]
    return at, best / len(item), float(np.isin(answer, part).mean()) if len(answer) else 1.0


def _windows(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(terms, times, window, windows) of every chunk of texts of the corpus, written."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, raw in chunks(_lower(batch["text"])):
                term, times, window, n = Chunk(raw).counted(held.value)
                # A window has at most WINDOW words, so a count is one byte.
                row = [term.astype("<i4").tobytes(), times.astype(np.uint8).tobytes(), window.astype("<i4").tobytes(), n]
                yield pd.DataFrame([row], columns=["terms", "times", "window", "windows"])

    return written(docs.select("text").mapInPandas(run, "terms binary, times binary, window binary, windows long"), "windows")


def _read(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for terms, times, window in zip(batch["terms"], batch["times"], batch["window"]):
        yield np.frombuffer(terms, "<i4"), np.frombuffer(times, np.uint8), np.frombuffer(window, "<i4")


def _added(partial: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of (block, part, values), added up on executors; what reaches the driver has the size of one sum."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for block, part, values in zip(batch["block"], batch["part"], batch["values"]):
                more = np.frombuffer(values)
                sums[block, part] = sums[block, part] + more if (block, part) in sums else more
        if sums:
            yield pd.DataFrame([(b, p, x.tobytes()) for (b, p), x in sums.items()], columns=["block", "part", "values"])

    out = [np.zeros(n) for n in sizes]
    for row in partial.repartition("block", "part").mapInPandas(run, partial.schema).toLocalIterator(prefetchPartitions=True):
        values = np.frombuffer(row["values"])
        out[row["block"]][row["part"] * _PART :][: len(values)] = values
    return out


def latent_bases(windows: DataFrame, vocabulary: np.ndarray, blocks: list[Block], idfs: list[np.ndarray], seed: int = 7) -> list[np.ndarray]:
    """For each block the right singular vectors (one row per term) of the TF-IDF windows of the whole corpus and of its items.

    Randomised range finder: the corpus adds up A'(A omega), which is made orthonormal; a second
    round adds up (AQ)'(AQ), whose eigenvectors rotate Q to the singular vectors. Rows of A are scaled to length 1.
    """
    places = []
    for block in blocks:
        place = np.full(len(vocabulary), -1)
        place[_places(vocabulary, block.vocabulary)] = np.arange(len(block.vocabulary))
        places.append(place)

    def rows(terms: np.ndarray, times: np.ndarray, window: np.ndarray, place: np.ndarray, idf: np.ndarray) -> Iterator[tuple]:
        """(term, value, row, first value of each row) of at most _ROWS windows at a time; terms of other blocks are left out."""
        known = np.flatnonzero(place[terms] >= 0)
        term, window = place[terms[known]], window[known]
        value = times[known] * idf[term]
        _, first, row = np.unique(window, return_index=True, return_inverse=True)
        value = (value / np.maximum(np.sqrt(np.bincount(row, weights=value * value)), 1e-12)[row]).astype(np.float32)
        ends = np.append(first, len(row))
        for a in range(0, len(first), _ROWS):
            b = min(a + _ROWS, len(first))
            lo, hi = ends[a], ends[b]
            yield term[lo:hi], value[lo:hi, None], row[lo:hi] - a, first[a:b] - lo

    def both(kind: str, matrices: list[np.ndarray]) -> list[np.ndarray]:
        shapes = [m.shape if kind == "range" else (m.shape[1], m.shape[1]) for m in matrices]
        held = windows.sparkSession.sparkContext.broadcast(list(zip(places, idfs, [m.astype(np.float32) for m in matrices])))

        @tidy
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals, seen = [np.zeros(shape) for shape in shapes], False
            for batch in batches:
                for chunk in _read(batch):
                    seen = True
                    for total, (place, idf, matrix) in zip(totals, held.value):
                        for term, value, row, first in rows(*chunk, place, idf):
                            y = np.add.reduceat(matrix[term] * value, first, axis=0)
                            if kind == "range":
                                order = np.argsort(term, kind="stable")
                                different, begin = np.unique(term[order], return_index=True)
                                total[different] += np.add.reduceat((y[row] * value)[order], begin, axis=0)
                            else:
                                total += y.T @ y
            for number, total in enumerate(totals if seen else []):
                flat = total.reshape(-1)
                parts = range(-(-len(flat) // _PART))
                yield pd.DataFrame([(number, k, flat[k * _PART : (k + 1) * _PART].tobytes()) for k in parts], columns=["block", "part", "values"])

        sums = _added(windows.select("terms", "times", "window").mapInPandas(run, "block int, part int, values binary"), [a * b for a, b in shapes])
        return [x.reshape(shape) for x, shape in zip(sums, shapes)]

    # The items are the rows to be told apart; they weigh as much as all windows of the corpus together.
    items, omegas = [], []
    for block, idf in zip(blocks, idfs):
        v = len(block.vocabulary)
        omegas.append(np.random.default_rng(seed).standard_normal((v, min(RANK + OVERSAMPLE, v))))
        own = np.stack([np.bincount(block.terms(x), minlength=v) * idf for x in block.items])
        items.append(own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12))
    bases = []
    for b, own, omega in zip(both("range", omegas), items, omegas):
        mine = own.T @ (own @ omega)
        bases.append(np.linalg.qr(b / max(np.linalg.norm(b), 1e-12) + mine / max(np.linalg.norm(mine), 1e-12))[0])
    out = []
    for gram, own, q in zip(both("gram", bases), items, bases):
        mine = (own @ q).T @ (own @ q)
        _, rotate = np.linalg.eigh(gram / max(np.trace(gram), 1e-12) + mine / max(np.trace(mine), 1e-12))
        out.append((q @ rotate[:, ::-1][:, :RANK]).astype(np.float32))
    return out


def _frequencies(windows: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Number of windows of the whole corpus that hold each term, and of all windows."""

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(terms, np.int64), 0
        for batch in batches:
            n += int(batch["windows"].sum())
            for term, _, _ in _read(batch):
                total += np.bincount(term, minlength=terms)
        yield pd.DataFrame({"term": np.append(np.arange(terms), -1), "n": np.append(total, n)}).query("n > 0")

    out = np.zeros(terms + 1)
    for row in windows.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out[:-1], int(out[-1])


def _searched(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    vocabulary = np.unique(np.concatenate([b.vocabulary for b in blocks]))
    windows = _windows(docs, vocabulary)
    frequency, n = _frequencies(windows, len(vocabulary))
    idfs = [np.log((n + 1) / (frequency[_places(vocabulary, b.vocabulary)] + 1)) + 1e-3 for b in blocks]
    parts = []
    for block, idf, basis in zip(blocks, idfs, latent_bases(windows, vocabulary, blocks, idfs)):
        basis = basis * idf[:, None].astype(np.float32)
        latent = np.stack([basis[block.terms(x)].sum(axis=0) for x in block.queries])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        parts.append((block, basis, latent.astype(np.float32)))
    held = docs.sparkSession.sparkContext.broadcast(parts)

    def found_in(chunk: Chunk, block: Block, basis: np.ndarray, latent: np.ndarray) -> Iterator[tuple]:
        """(text, item, start, cosine, subsequence share, answer share) of the chunk's texts."""
        vectors, begin = chunk.projected(block.terms(chunk.hash), basis)
        cosine = np.maximum.reduceat(vectors @ latent.T, block.first, axis=1)
        passages, items = np.divmod(np.flatnonzero(cosine >= COSINE), len(block.ids))
        text = np.searchsorted(chunk.of_text, begin[passages], "right") - 1
        for p, i, t in zip(passages, items, text):
            at = int(chunk.piece[begin[p]])
            around = max(STRIDE, -(-5 * len(block.items[i]) // 4))
            lo, hi = max(int(chunk.first[t]), at - around), min(int(chunk.first[t + 1]), at + WINDOW + around)
            start, share, answer = checked(chunk.hash[lo:hi], block.items[i], block.answers[i])
            if share >= LCS_SHARE and answer >= block.least_answer:
                yield t, block.ids[i], lo + start - int(chunk.first[t]), float(cosine[p, i]), share, answer

    @tidy
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for first, raw in chunks(_lower(batch["text"])):
                chunk = Chunk(raw)
                found += [(first + t, *rest) for part in held.value for t, *rest in found_in(chunk, *part)]
            frame = pd.DataFrame(found, columns=["row", "item_id", "start_word", "cosine", "lcs_share", "answer_share"])
            # A row lies in one batch whole, so its best place of an item is known here.
            best = frame.sort_values(["lcs_share", "cosine", "start_word"], ascending=[False, False, True]).drop_duplicates(["row", "item_id"]).sort_values(["row", "item_id"])
            ids = batch["doc_id"].iloc[best["row"]].reset_index(drop=True)
            yield best.drop(columns="row").reset_index(drop=True).assign(doc_id=ids)

    # As text, an id keeps its value beside nulls.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(search, f"doc_id string, {_RESULT}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, cosine, lcs_share, answer_share) of every item found in a document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.filter("text IS NOT NULL")
    has_answer = "answer" in benchmark.columns
    answer = F.col("answer") if has_answer else F.regexp_extract(F.trim("text"), r"([^.!?\n]*)[.!?\s]*$", 1)
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", answer.alias("answer")).orderBy("item_id", "text")
    out = docs.limit(0).select("doc_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in _RESULT.split(", "))])
    blocks, held, size = [], [], 0

    def closed(blocks: list[Block], held: list) -> list[Block]:
        return [*blocks, Block(held, ANSWER_SHARE if has_answer else 0.0)] if held else blocks

    for row in rows.toLocalIterator():
        parts = len(_parts(_words(row["text"]))) if len(_words(row["text"])) else 0
        if parts:
            held.append(row)
            size += parts
        if size >= BLOCK_ITEMS:
            blocks, held, size = closed(blocks, held), [], 0
        if len(blocks) == PASS_BLOCKS:
            out, blocks = out.unionByName(_searched(docs, blocks)), []
    if blocks := closed(blocks, held):
        out = out.unionByName(_searched(docs, blocks))
    return out
