"""Removal of repeated byte strings: suffix arrays over shards of the text that may repeat.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

1. Copies of a whole text are found by its digest; all but the first go as a whole.
2. Each window of LENGTH bytes has an anchor: the GRAM-byte string in it with the smallest hash. Equal windows have
   equal anchors. Anchors that occur in one text only are dropped. The others are named after the text
   that has them with the smallest hash and its block of BLOCK bytes they are in: equal windows have the same name.
3. Around anchors with one name and one shift against that text, a segment of text is cut, wide enough for
   every window with such an anchor. Equal segments with one name are counted once, with their first document.
4. Segments go to shards by name. A shard's suffix array is made by induced sorting, and permuted common
   prefixes part it into groups of equal windows; those with a smaller doc_id in their group are marked.
   A name whose distinct segments have more than SHARD_BYTES is dealt over several shards. Each of these tells every
   group's window once, by digest, with its least doc_id, and hears which windows have a smaller one elsewhere.
5. Marked windows become spans of their documents, which are cut out of the text.

So anchors only decide which texts meet; the suffix arrays decide what repeats. No document or name is
gathered in one place, and shards have about SHARD_BYTES bytes. Anchors travel as arrays, in buckets of about
BUCKET_ROWS. A gram with more than HOT_ROWS places in FLUSH_BYTES of text sends its first and last place alone to its bucket;
its other places meet the name that comes of it in a join, which Spark may split.

Null text is empty. Rows with a null doc_id are kept whole and compared with nothing. Rows with equal doc_id
are not earlier than one another, so their texts remove nothing from each other. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, id_filter, may_hold, partitions, release, small_batches, tidy, written
from .hashing import chunks, running, window
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM, BLOCK = 50, 20, 1024
FLUSH_BYTES, BUCKET_ROWS, HOT_ROWS = 1 << 23, 1 << 19, 32
#: Bytes of text whose anchors are found at once: few enough for a core's cache.
_CHUNK = 1 << 16
#: Digests of texts that a task remembers, to pass over copies.
_REMEMBERED = 200_000
#: Rows of a table that is small enough to be sent to every task.
_SENT_ROWS = 100_000
#: Bytes of distinct segments for which a shard is made.
SHARD_BYTES = 1 << 19
_SPREAD = LENGTH - GRAM + 1  # grams of a window


def anchors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all windows of each text."""
    sizes = np.asarray([len(x) for x in raw])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    n = len(data) - GRAM + 1
    h = window(running(data), slice(0, n), slice(GRAM, n + GRAM))
    key = (h & ~np.uint64(63)) | (np.arange(n, dtype=np.uint64) & np.uint64(63))  # the low bits tell the place within a window
    low = np.minimum(key[:-1], key[1:])
    for step in (2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n - _SPREAD + 1], low[_SPREAD - 16 :][: n - _SPREAD + 1])
    # Windows side by side mostly have one anchor; the first of them tells it.
    new = np.append(True, low[1:] != low[:-1])
    new[begin[begin < len(low)]] = True
    start = np.flatnonzero(new)
    text = np.searchsorted(ends, start, "right")
    whole = start + LENGTH <= ends[text]
    start, text = start[whole], text[whole]
    place = start + (((low[start] & np.uint64(63)).astype(np.int64) - start) & 63)
    return text, place - begin[text], h[place]


_NAMED = pa.schema([("row_key", pa.int64()), ("place", pa.int32()), ("gram", pa.int64()), ("name_doc", pa.int64()), ("name_place", pa.int32())])
_NAMED_DDL = "row_key long, place int, gram long, name_doc long, name_place int"


def _groups(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by gram, the starts of its groups in that order, and their sizes."""
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return order, starts, np.diff(np.append(starts, len(gram)))


def _dealt(gram: np.ndarray, key: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, hot, gram, key, place) as arrays of bytes. Of a hot gram the places go to buckets by text, and only their ends by gram."""
    order, starts, sizes = _groups(gram)
    hot = np.empty(len(gram), bool)
    hot[order] = np.repeat(sizes > HOT_ROWS, sizes)
    at, of = np.flatnonzero(hot), None
    to = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    kinds = [(False, np.flatnonzero(~hot), to)]
    if len(at):
        order, starts, sizes = _groups(gram[at])
        order = at[np.lexsort((place[at], key[at], gram[at]))]
        ends = np.unique(np.append(order[starts], order[starts + sizes - 1]))
        of = (key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        kinds += [(None, ends, to), (True, at, of.astype(np.int64))]
    for kind, rows, bucket in kinds:
        rows = rows[np.argsort(bucket[rows].astype(np.uint16) if buckets < 1 << 16 else bucket[rows], kind="stable")]
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[rows]) != 0)) if len(rows) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(rows)) if len(rows) else []):
            part = rows[a:b]
            yield int(bucket[part[0]]), kind, gram[part].tobytes(), key[part].tobytes(), place[part].tobytes()


def _named_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors of grams that two texts or more have, with the first of them by (row_key, place) as their name.

    A row has no gram if it is named; rows with a gram are either places of a hot one (no name) or its name (no place).
    """
    schema = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("gram", pa.binary()), ("key", pa.binary()), ("place", pa.binary())])

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*_dealt(*(np.concatenate(c) for c in zip(*held)), buckets))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, raw in chunks(batch.column(1).to_pylist(), _CHUNK):
                fresh = []
                for x in raw:  # a copy of a text has nothing to add; stage 1 knows it
                    key = hashlib.blake2b(x, digest_size=16).digest()
                    fresh.append(x if len(x) >= LENGTH and key not in seen else b"")
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(key)
                text, place, h = anchors(fresh)
                if len(h):
                    held.append((h, keys[first + text].astype(np.int64), place.astype(np.int32)))
                size += sum(map(len, fresh))
                if held and size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for hot, *columns in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                gram, key, place = (np.frombuffer(c, t) for c, t in zip(columns, (np.uint64, np.int64, np.int32)))
                if hot:
                    none = pa.nulls(len(gram))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(gram.view(np.int64)), none.cast(pa.int64()), none.cast(pa.int32())], schema=_NAMED)
                else:
                    parts.append((gram, key, place, np.full(len(gram), hot is None)))
        if not parts:
            return
        gram, key, place, end = (np.concatenate(c) for c in zip(*parts))
        del parts
        order, starts, sizes = _groups(gram)
        gram, key, place, end = gram[order], key[order], place[order], end[order]
        first, last = np.minimum.reduceat(key, starts), np.maximum.reduceat(key, starts)
        at = np.minimum.reduceat(np.where(key == np.repeat(first, sizes), place, np.iinfo(np.int32).max), starts)
        shared = first < last
        rows = np.repeat(shared, sizes) & ~end
        none = pa.nulls(int(rows.sum())).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(place[rows]), none, pa.array(np.repeat(first, sizes)[rows]), pa.array(np.repeat(at, sizes)[rows])], schema=_NAMED)
        names = np.flatnonzero(shared & np.logical_or.reduceat(end, starts))
        none = pa.nulls(len(names))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), pa.array(gram[starts[names]].view(np.int64)), pa.array(first[names]), pa.array(at[names])], schema=_NAMED)

    blobs = docs.select(F.xxhash64("text").alias("row_key"), "text").mapInArrow(emit, "bucket int, hot boolean, gram binary, key binary, place binary")
    rows = written(blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(name, _NAMED_DDL), "anchors")
    names = rows.filter("row_key IS NULL").select("gram", "name_doc", "name_place")
    if names.isEmpty():
        return rows.drop("gram")
    places = rows.filter("gram IS NOT NULL AND row_key IS NOT NULL").select("gram", "row_key", "place").join(names, "gram")
    return rows.filter("gram IS NULL").drop("gram").unionByName(places.drop("gram"))


def marked(texts: list[bytes], owners: np.ndarray, elsewhere: dict[bytes, int] | None = None) -> list[list[tuple[int, int]]]:
    """For each text, the spans covered by windows that also start in a text with a smaller owner; `elsewhere`: least owners by digest."""
    return Windows(texts, owners).spans(elsewhere or {})


class Windows:
    """Windows of texts, in groups of equal ones by their suffix array, with the least owner of each group."""

    def __init__(self, texts: list[bytes], owners: np.ndarray):
        sizes = np.asarray([len(t) for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.text = np.append(np.repeat(np.arange(len(texts)), sizes + 1), len(texts) - 1)
        # 0 ends the whole, 1 parts texts, bytes follow, without those that no text holds.
        self.raw = np.frombuffer(b"\xff".join(texts) + b"\xff\xff", np.uint8)
        part = np.zeros(len(self.raw), bool)
        part[self.begin + sizes] = True
        used = np.bincount(self.raw[~part], minlength=256)
        used[255] -= 1  # the end
        s = (np.cumsum(used > 0) + 1)[self.raw].astype(np.uint8 if (used > 0).sum() < 254 else np.int16)
        s[part], s[-1] = 1, 0
        self.sa = suffix_array(s, int(s.max()) + 1)
        prefix = common_prefixes(self.raw, self.sa, LENGTH)
        self.whole = np.arange(len(s)) + LENGTH <= (self.begin + sizes)[self.text]
        self.starts = np.flatnonzero(prefix[self.sa] < LENGTH)
        self.ordered = np.where(self.whole[self.sa], owners[self.text[self.sa]], np.iinfo(np.int64).max)
        self.least = np.minimum.reduceat(self.ordered, self.starts)

    def digests(self) -> tuple[np.ndarray, list[bytes]]:
        """The groups of whole windows, and a digest of each one's bytes."""
        groups = np.flatnonzero(self.whole[self.sa[self.starts]])
        raw = self.raw.tobytes()
        return groups, [hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in self.sa[self.starts[groups]].tolist()]

    def spans(self, elsewhere: dict[bytes, int]) -> list[list[tuple[int, int]]]:
        begin, text, sa, least = self.begin, self.text, self.sa, self.least.copy()
        if elsewhere:
            groups, digests = self.digests()
            least[groups] = np.minimum(least[groups], [elsewhere.get(d, np.iinfo(np.int64).max) for d in digests])
        hit = np.zeros(len(sa), bool)
        hit[sa] = self.whole[sa] & (self.ordered > np.repeat(least, np.diff(np.append(self.starts, len(sa)))))
        spans: list[list[tuple[int, int]]] = [[] for _ in begin]
        found = np.flatnonzero(hit)
        if len(found):
            cut = np.flatnonzero((np.diff(found) > LENGTH) | (np.diff(text[found]) > 0))
            for a, b in zip(found[np.append(0, cut + 1)], found[np.append(cut, len(found) - 1)]):
                spans[text[a]].append((int(a - begin[text[a]]), int(b - begin[text[a]]) + LENGTH))
        return spans


def shared_runs(texts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of runs of windows that have the hash of a window of another owner; equal windows have equal hashes, so none is missed."""
    sizes = np.asarray([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    at = np.flatnonzero(np.arange(LENGTH, n + LENGTH) <= ends[text])
    text = text[at]
    key = window(running(data), slice(0, n), slice(LENGTH, n + LENGTH))[at]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(at) else order
    by = owners[text[order]]
    hit = np.zeros(len(at), bool)
    if len(at):
        hit[order] = np.repeat(np.minimum.reduceat(by, starts) < np.maximum.reduceat(by, starts), np.diff(np.append(starts, len(at))))
    text, found = text[hit], (at - (ends - sizes)[text])[hit]
    if not len(found):
        return text, found, found
    cut = np.flatnonzero((np.diff(found) != 1) | (np.diff(text) > 0))
    first, last = np.append(0, cut + 1), np.append(cut, len(found) - 1)
    return text[first], found[first], found[last] + LENGTH


def marked_runs(texts: list[bytes], owners: np.ndarray) -> list[list[tuple[int, int]]]:
    """As marked(), but spans may overlap.

    Only shared_runs are looked at, equal ones once, for their least owner: a later owner's run is marked as a whole. As long as this saves half of
    the bytes, the runs are texts anew; what is left has a suffix array.
    """
    runs = [(t, a, texts[t][a:b]) for t, a, b in zip(*(x.tolist() for x in shared_runs(texts, owners)))]
    least: dict[bytes, int] = {}
    for t, _, run in runs:
        least[run] = min(int(owners[t]), least.get(run, int(owners[t])))
    left, size = sum(map(len, least)), sum(map(len, texts))
    if left > size:  # many short runs, one in the other
        return marked(texts, owners)
    own: dict[bytes, list[tuple[int, int]]] = {}
    if least:
        own = dict(zip(least, (marked_runs if 2 * left <= size else marked)(list(least), np.asarray(list(least.values())))))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for t, a, run in runs:
        spans[t] += [(a, a + len(run))] if owners[t] > least[run] else [(a + x, a + y) for x, y in own[run]]
    return spans


_SPANS = "sid binary, first_doc long, spans array<struct<start:long,stop:long>>"


def _marked_shard(shard: pd.DataFrame, elsewhere: dict[bytes, int] | None = None) -> pd.DataFrame:
    """Without `elsewhere`, the shard has all segments of its names."""
    shard = shard.sort_values("sid")
    texts, owners = list(shard["data"]), shard["first_doc"].to_numpy()
    spans = marked_runs(texts, owners) if elsewhere is None else marked(texts, owners, elsewhere)
    give_back()
    return shard[["sid", "first_doc"]].assign(spans=[[{"start": a, "stop": b} for a, b in x] for x in spans])


def _marked_segments(segments: DataFrame) -> DataFrame:
    """Spans of segments (sid, first_doc, data, shard). The names of shards below 0 have other shards, too."""

    def own(shard: pd.DataFrame) -> pd.DataFrame:
        return _marked_shard(shard)

    def told(shard: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(list(shard["data"]), shard["first_doc"].to_numpy())
        groups, digests = windows.digests()
        return pd.DataFrame({"shard": shard["shard"].iloc[0], "window": digests, "least": windows.least[groups]})

    def heard(shard: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        return _marked_shard(shard, dict(zip(elsewhere["window"], elsewhere["least"])))

    alone = segments.filter("shard >= 0").groupBy("shard").applyInPandas(own, _SPANS)
    dealt = written(segments.filter("shard < 0"), "dealt")
    release(segments.sparkSession)
    if dealt.isEmpty():
        return alone
    # A window has a row for each shard that holds it, not for each text.
    windows = dealt.groupBy("shard").applyInPandas(told, "shard long, window binary, least long")
    least = F.min("least").over(Window.partitionBy("window"))
    smaller = written(windows.withColumn("all", least).filter("all < least").select("shard", "window", F.col("all").alias("least")), "smaller")
    release(segments.sparkSession)
    return alone.unionByName(dealt.groupBy("shard").cogroup(smaller.groupBy("shard")).applyInPandas(heard, _SPANS))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    """Segments (sid, name_doc, name_block, size, ...) with a shard: 0 or more by name, below 0 for parts of a name of more than SHARD_BYTES."""
    name = ["name_doc", "name_block"]
    large = distinct.groupBy(*name).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > SHARD_BYTES)
    parts = written(large.select(*name, F.expr(f"bytes div {SHARD_BYTES} + 1").alias("parts")), "parts")
    by_name = F.pmod(F.xxhash64(*name), F.lit(shards)).cast("long")
    few = parts.limit(_SENT_ROWS + 1).count()
    if not few:
        return distinct.withColumn("shard", by_name)
    part = F.xxhash64(*name, F.pmod(F.xxhash64("sid"), "parts"))
    joined = distinct.join(F.broadcast(parts) if few <= _SENT_ROWS else parts, name, "left")
    return joined.withColumn("shard", F.when(F.col("parts").isNull(), by_name).otherwise(-1 - F.shiftrightunsigned(part, 1))).drop("parts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    data = F.encode("text", "UTF-8")
    row_key = F.xxhash64("text")
    facts = docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"), row_key.alias("row_key"))
    first = facts.filter("doc_id IS NOT NULL").groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("class"))
    facts = written(facts.join(first, ["sha", "n_bytes"], "left"), "facts")

    # Stage 2. Texts go by their hash here: what only copies of one text share needs no suffix array, stage 1 has it.
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions(spark), 2 * total // (_SPREAD + 1) // BUCKET_ROWS + 1)
    rows = _named_anchors(docs.filter("doc_id IS NOT NULL"), buckets)
    named = rows.groupBy("row_key", "name_doc", F.expr(f"name_place div {BLOCK}").alias("name_block"), (F.col("place") - F.col("name_place")).alias("shift"))
    ranges = named.agg(F.min("place").alias("low"), F.max("place").alias("high"))
    ranges = ranges.select("row_key", "name_doc", "name_block", F.greatest(F.col("low") - (LENGTH - GRAM), F.lit(0)).alias("low"), (F.col("high") + LENGTH).alias("high"))
    lists = ranges.groupBy("row_key").agg(F.collect_list(F.struct("name_doc", "name_block", "low", "high")).alias("ranges"))

    # Stage 3. Texts move only if they have a segment. They are the first of their copies, so their class is their doc_id.
    firsts_of = facts.filter("doc_id = class").select("doc_id", "row_key").distinct()
    cut = F.transform("ranges", lambda r: F.struct(r["name_doc"].alias("name_doc"), r["name_block"].alias("name_block"), r["low"].alias("low"), F.substring(F.col("data"), r["low"] + 1, r["high"] - r["low"]).alias("data")))
    held = written(lists.join(firsts_of, "row_key"), "lists")
    release(spark)
    texts = _texts(docs, held.select("doc_id").distinct()).withColumns({"data": F.encode("text", "UTF-8"), "row_key": row_key}).drop("text")
    pieces = texts.join(held, ["doc_id", "row_key"]).select("doc_id", "row_key", F.explode(cut).alias("s")).select("doc_id", "row_key", "s.*").filter(F.octet_length("data") >= LENGTH)
    name = F.encode(F.concat_ws(":", "name_doc", "name_block", F.lit("")), "UTF-8")
    pieces = pieces.withColumns({"size": F.octet_length("data"), "sid": F.unhex(F.md5(F.concat(name, F.col("data"))))})
    pieces = written(pieces, "segments")
    release(spark)
    placed = pieces.select("doc_id", "row_key", "low", "size", "sid")
    distinct = pieces.groupBy("sid").agg(F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in ("name_doc", "name_block", "size", "data")))
    distinct = written(distinct, "distinct")
    release(spark)
    shards = max(partitions(spark), (distinct.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES + 1)
    distinct = _sharded(distinct, shards).select("sid", "first_doc", "data", "shard")

    # Stage 4 and 5. A later document's copy of a segment is marked as a whole.
    spans = written(_marked_segments(distinct), "spans")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    joined = placed.join(spans, "sid").withColumn("spans", F.when(F.col("doc_id") > F.col("first_doc"), everything).otherwise(F.col("spans"))).filter(F.size("spans") > 0)
    moved = joined.select("doc_id", "row_key", F.explode("spans").alias("s"), "low").select("doc_id", "row_key", (F.col("s.start") + F.col("low")).alias("start"), (F.col("s.stop") + F.col("low")).alias("stop"))
    spans_of = written(moved.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")), "doc-spans")
    release(spark)

    @tidy
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, key, text, spans in zip(batch["doc_id"], batch["row_key"], batch["text"], batch["spans"]):
                raw, parts, at, removed, count = text.encode(), [], 0, 0, 0
                stop = -1
                for s in spans:
                    if s["start"] > stop:
                        count += 1
                        parts.append(raw[at : s["start"]])
                        removed += s["stop"] - s["start"]
                    elif s["stop"] > stop:
                        removed += s["stop"] - stop
                    stop = at = max(stop, s["stop"])
                out.append((doc_id, key, removed, count, hashlib.sha256(b"".join(parts) + raw[at:]).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "row_key", "n_removed", "n_spans", "kept_sha256"])

    firsts = spans_of.join(firsts_of, ["doc_id", "row_key"])
    cut_texts = _texts(docs, firsts.select("doc_id").distinct()).withColumn("row_key", row_key).dropDuplicates(["doc_id", "row_key"])
    changed = cut_texts.join(firsts, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "spans").mapInPandas(kept, "doc_id long, row_key long, n_removed long, n_spans long, kept_sha256 string")
    result = facts.join(changed, ["doc_id", "row_key"], "left")
    copy = (F.col("doc_id") > F.col("class")) & (F.col("n_bytes") >= LENGTH)
    return result.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted documents; most others are passed over where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(take, "doc_id long, text string").join(wanted, "doc_id", "left_semi")
