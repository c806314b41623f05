"""Chunking that packs pieces in order: by separators, by sentences, by drops in similarity.

Packing depends on what came before it in the same text, so it runs per text in Arrow batches; all else is
expressions. Chunks carry the true offsets of their own body; an overlap is kept apart in `overlap`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches, tidy
from .retrieval import cosine

#: Separators from the coarsest to the finest, by language; other languages have the general ones.
SEPARATORS = {
    "general": ("\n\n\n", "\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ",", " "),
    "japanese": ("\n\n\n", "\n\n", "\n", "。", "！", "？", "・", "、", " "),
}
_SENTENCE = re.compile(r"[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+")
#: Chunks that leave a worker in one batch.
OUT_ROWS = 2_000
CHUNK = "{key} {kind}, index int, start int, stop int, overlap string, body string"


def language_of(text: str) -> str:
    han = sum("一" <= c <= "鿿" for c in text)
    kana = sum("぀" <= c <= "ヿ" for c in text)
    return "japanese" if kana > 0.1 * han else "chinese" if han > 0.3 * len(text) else "general"


def _cuts(text: str, separator: str) -> list[tuple[int, int]]:
    """Pieces that end behind each separator, as spans; blank ones go."""
    ends = [m.end() for m in re.finditer(re.escape(separator), text)] + [len(text)]
    spans = list(zip([0, *ends[:-1]], ends))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def _packed(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined while they fit into `size` characters together."""
    out: list[tuple[int, int]] = []
    used = 0
    for a, b in spans:
        if out and used + b - a <= size:
            out[-1] = (out[-1][0], b)
            used += b - a
        else:
            out.append((a, b))
            used = b - a
    return out


def recursive_chunks(text: str, size: int = 512, overlap: int = 50, language: str | None = None) -> list[tuple[int, int, str]]:
    """(start, stop, overlap): the coarsest separator whose pieces all fit decides; without one, fixed windows."""
    if not text.strip():
        return []
    spans = [(0, len(text))]
    if len(text) > size:
        for separator in SEPARATORS.get(language or language_of(text), SEPARATORS["general"]):
            pieces = _cuts(text, separator)
            if all(b - a <= size for a, b in pieces):
                spans = _packed(pieces, size)
                break
        else:
            return [(a, min(a + size, len(text)), "") for a in range(0, len(text), size - overlap) if text[a : a + size].strip()]
    bodies = []
    for a, b in spans:
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        bodies.append((a, a + len(body.strip())))
    return [(a, b, text[max(bodies[k - 1][0], bodies[k - 1][1] - overlap) : bodies[k - 1][1]] if k and overlap else "") for k, (a, b) in enumerate(bodies)]


def sentence_chunks(text: str, size: int = 512, overlap_sentences: int = 1, least: int = 100) -> list[tuple[int, int, str]]:
    """Sentences packed up to `size`; a chunk under `least` characters is kept only if none came before it."""
    spans = [m.span() for m in _SENTENCE.finditer(text) if m[0].strip()]
    chunks, group = [], []
    for span in spans:
        if group and span[1] - group[0][0] > size:
            chunks.append(group)
            group = []
        group.append(span)
    if group:
        chunks.append(group)
    out: list[tuple[int, int, str]] = []
    for k, g in enumerate(chunks):
        if g[-1][1] - g[0][0] >= least or not out:
            before = chunks[k - 1][-overlap_sentences:] if k and overlap_sentences else []
            out.append((g[0][0], g[-1][1], text[before[0][0] : before[-1][1]] if before else ""))
    return out


def chunked(docs: DataFrame, how, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of every document by recursive_chunks, sentence_chunks or any function of a text to such triples.

    A worker holds one small batch of texts and OUT_ROWS chunks at a time.
    """
    small_batches(docs.sparkSession)

    def frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while some := list(islice(rows, OUT_ROWS)):
            yield pd.DataFrame(some, columns=[key, "index", "start", "stop", "overlap", "body"])

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from frames((k, i, a, b, o, t[a:b]) for k, t in zip(batch[key], batch[text]) if t for i, (a, b, o) in enumerate(how(t)))

    return docs.select(key, text).mapInPandas(run, CHUNK.format(key=key, kind=dict(docs.dtypes)[key]))


def similarity_segments(sentences: DataFrame, group: str, order: str, vector: str, threshold: float = 0.7) -> DataFrame:
    """segment: a new one starts where a sentence is less similar to the one before it than the threshold."""
    window = Window.partitionBy(group).orderBy(order)
    before = F.lag(vector).over(window)
    fresh = F.when(before.isNull(), 0).when(cosine(F.col(vector), before) < threshold, 1).otherwise(0)
    rows = sentences.withColumn("_fresh", fresh)
    return rows.withColumn("segment", F.sum("_fresh").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
