"""Similarity join of documents on word n-grams: exact Jaccard links by prefix filtering.

A document's set holds the hashes of its distinct shingles. Stages:

1. Documents with equal sets form one class at once (count and two sums of mixed hashes as the key).
2. Every shingle has a frequency from a counting sketch of fixed size that all documents fill. In the
   order (frequency, hash), rare first, two sets that link share one of their first
   n - ceil(t n) + 1 shingles: each document emits that prefix, once.
3. In each prefix group the member whose shingles are the most frequent is the pivot; others pair
   with it alone, under the length and positional filters. So a group of near copies costs a
   few pairs per member, not all pairs. Links join members to components. A group that the sketch says is large is
   dealt over parts by document, so that no task sorts it whole; each part has a pivot, and these pair with the first of them.
4. Groups that still hold several components pair their members across components (length and positional filters again),
   without pairs already looked at. Members of one component need no further link: the result is the components. In a group of more than
   SMALL_GROUP members the longer text looks up the shorter one by classes of length, only those that both filters leave
   it; so texts that merely share a template, too far down their prefixes to link, don't meet.
5. Each candidate pair is verified once: first by bounds on the overlap from the counts of shingles in CLASSES classes
   of hashes, so that whole sets travel only for pairs that may link; then by the suffix filter (bounds from halving the
   sorted suffixes around a middle shingle) and the size of the intersection.

Null text and text without words have an empty set and link with nothing. A null doc_id keeps its row and its
count, but takes no part in links. Rows that repeat a doc_id are one document, linked by any of its texts: further texts of an id are
nodes of their own while links are sought (numbered above all ids, which must leave room for that), tied to the id by a link. Each row has the count
of its own text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_filter, may_hold, release, small_batches, tidy, written
from .components import components
from .hashing import chunks, mixed, shingle_sets
from .packing import ranked

WIDTH, PERCENT = 5, 75
#: Counters of the frequency sketch, in blocks that are summed apart.
COUNTERS, COUNTER_BLOCK = 1 << 20, 1 << 14
#: Classes of hashes whose counts bound an overlap; a count is one byte, and 255 stands for more.
CLASSES = 256
#: Members of a part of a prefix group, about. Few groups are so large; what a full sketch says of others is evened out by its mean.
PART_ROWS = 200_000
#: Members of a prefix group that are paired without classes of length, and the ratio of neighbouring classes.
SMALL_GROUP, LENGTHS = 32, 1.08
#: Frequencies are kept as so many times the binary logarithm of one more.
_SCALE = 1500
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: a document's set size, key and class counts; a partition's share of the sketch."""

    @tidy
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        top = np.uint64(64 - CLASSES.bit_length() + 1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, raw in chunks(texts):
                sets = shingle_sets(raw, width)
                keys = np.zeros((len(sets), 2), np.uint64)
                for k, s in enumerate(sets):
                    keys[k] = s.sum(), mixed(s ^ _SALT).sum()
                counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                kinds = [np.minimum(np.bincount((s >> top).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(keys[:, 0].copy())), pa.array(_signed(keys[:, 1].copy())), pa.nulls(len(sets)).cast(pa.int32()), pa.array(kinds, pa.binary())], schema=schema)
        filled = [k for k in range(COUNTERS // COUNTER_BLOCK) if counts[k * COUNTER_BLOCK : (k + 1) * COUNTER_BLOCK].any()]
        none = pa.nulls(len(filled)).cast(pa.int64())
        import zlib

        packed = [zlib.compress(counts[k * COUNTER_BLOCK : (k + 1) * COUNTER_BLOCK].astype("<u4").tobytes(), 1) for k in filled]
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(filled, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(profile, "doc_id long, n long, key1 long, key2 long, block int, counts binary")


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Frequencies on a scale of 16 bits, summed block by block on executors; its size is fixed."""

    @tidy
    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"], batch["counts"]):
                part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        scaled = [np.minimum(65535, np.log2(1 + s) * _SCALE).astype("<u2").tobytes() for s in sums.values()]
        yield pd.DataFrame({"block": list(sums), "counts": scaled})

    blocks = COUNTERS // COUNTER_BLOCK
    rows = profiles.filter("block IS NOT NULL").select("block", "counts")
    rows = rows.repartition(blocks, "block").mapInPandas(total, "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint16)
    for row in rows.collect():
        out[row["block"] * COUNTER_BLOCK : (row["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(row["counts"], "<u2")
    return out


def _prefixes(docs: DataFrame, width: int, percent: int, sketch: np.ndarray, part_rows: int) -> DataFrame:
    """(gram, doc_id, n, place, centre, part): the rare-first prefix of every document, and its part of the gram's group; -1: the group is not dealt."""
    held, noise = docs.sparkSession.sparkContext.broadcast(sketch), float(np.exp2(sketch / _SCALE).mean())
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("centre", pa.int32()), ("part", pa.int32())])

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = held.value, set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for first, raw in chunks(texts):
                grams, owner, size, place, centre, often = [], [], [], [], [], []
                for k, s in enumerate(shingle_sets(raw, width)):
                    n = len(s)
                    key = (n, int(s.sum()), int(mixed(s ^ _SALT).sum())) if n else None
                    if not n or key in seen:  # one document of a class is enough; stage 1 has the others
                        continue
                    seen.add(key)
                    counts = rank[s & np.uint64(COUNTERS - 1)]
                    first_ones = np.argsort(counts, kind="stable")[: n + (-percent * n // 100) + 1]
                    kept = s[first_ones]
                    grams.append(kept)
                    often.append(counts[first_ones])
                    owner.append(ids[first + k])
                    size.append(n)
                    place.append(np.arange(len(kept)))
                    centre.append(int(counts.mean()))
                if grams:
                    times = [len(g) for g in grams]
                    members = np.exp2(np.concatenate(often) / _SCALE) - noise
                    parts = np.maximum(1, members // part_rows).astype(np.int64)
                    owners = np.repeat(owner, times).astype(np.int64)
                    part = np.where(parts > 1, (mixed(owners.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % parts, -1)
                    columns = [_signed(np.concatenate(grams)), owners, np.repeat(size, times).astype(np.int32), np.concatenate(place).astype(np.int32), np.repeat(centre, times).astype(np.int32), part.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(emit, "gram long, doc_id long, n int, place int, centre int, part int")


def _may_link(n: str, place: str, m: str, at: str, percent: int):
    """Length and positional filters for the first shingle that two sets share."""
    n, place, m, at = (F.col(x).cast("long") for x in (n, place, m, at))
    least = F.lit(percent) * (n + m)  # intersection * (100 + percent) >= percent * (n + m)
    most = F.least(n - place, m - at)
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * most >= least)


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(LENGTHS)).cast("int")


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different parts whose members may link by a gram; `rest` has the number of the group's members."""
    small, n = F.col("members") <= SMALL_GROUP, F.col("n").cast("long")
    # The longest text that a member's place in the prefix leaves it, and the shortest that its length does; one class is added for rounding.
    most = F.least(n, F.floor(F.lit(100 + percent) * (n - F.col("place")) / F.lit(percent)) - n)
    least = F.ceil(F.lit(percent) * n / F.lit(100))
    sought = F.when(most >= least, F.sequence(_length_class(least) - 1, _length_class(most) + 1))
    longer = rest.withColumn("length", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(sought)))
    own = F.when(small, F.lit(-1)).otherwise(_length_class(n))
    shorter = rest.select("gram", own.alias("length"), F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("part").alias("part2"))
    once = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("part") < F.col("part2")))
    met = longer.join(shorter, ["gram", "length"]).filter("part <> part2").filter(once).filter(_may_link("n", "place", "n2", "place2", percent))
    return met.select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct()


def _overlap_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """At most so many shared values of two sorted arrays: halve around the middle of y, `depth` times."""
    if depth == 0 or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    middle = len(y) // 2
    cut = int(np.searchsorted(x, y[middle]))
    return _overlap_bound(x[:cut], y[:middle], depth - 1) + _overlap_bound(x[cut:], y[middle:], depth - 1)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                if _overlap_bound(x, y, 3) < least:
                    continue
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    kept.append(k)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _possible(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose class counts allow enough shared shingles."""

    @tidy
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CLASSES) for k in (4, 5))
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            full = ((x == 255) & (y == 255)).any(axis=1)
            keep = full | ((100 + percent) * most >= percent * n)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = pairs.join(counts.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("counts").alias("x")), "a")
    both = left.join(counts.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("counts").alias("y")), "b")
    return both.select("a", "b", "n1", "n2", "x", "y").mapInArrow(bound, "a long, b long")


def _sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted documents, computed where the text is read; only sets are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for first, raw in chunks(batch.column(1).to_pylist()):
                sets = [s.tobytes() for s in shingle_sets(raw, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["doc_id", "grams"])

    sets = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(collect, "doc_id long, grams binary")
    return sets.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("grams").alias("grams"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with another doc_id for every further text of an id, and these nodes (node, doc_id); None if each id has one text."""
    twice = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs, None
    digest = F.coalesce(F.md5("text"), F.lit("")).alias("digest")
    texts = docs.select("doc_id", digest).join(twice, "doc_id", "left_semi").distinct()
    first = texts.groupBy("doc_id").agg(F.min("digest").alias("first"))
    further = written(texts.join(first, "doc_id").filter("digest <> first").select("doc_id", "digest", F.lit(0).alias("all")), "texts")
    n, top = further.count(), docs.agg(F.max("doc_id")).first()[0]
    if not n:
        return docs, None
    if top + n >= 1 << 63:
        raise ValueError("doc_ids leave no room for the further texts of repeated ones")
    nodes = ranked(further, "all", ["doc_id", "digest"], "k", n).select("doc_id", "digest", (F.lit(top + 1) + F.col("k")).alias("node"))
    nodes = written(nodes, "nodes")
    named = docs.select("doc_id", "text", digest).join(nodes, ["doc_id", "digest"], "left")
    return written(named.select(F.coalesce("node", "doc_id").alias("doc_id"), "text"), "documents"), nodes.select("node", "doc_id")


def linked_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    small_batches(docs.sparkSession)
    docs, nodes = _apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = _linked(docs, nodes, width, percent, part_rows)
    if nodes is None:
        return out
    own = nodes.select("node", F.col("doc_id").alias("own"))
    return out.join(own, F.col("doc_id") == F.col("node"), "left").select(F.coalesce("own", "doc_id").alias("doc_id"), "n_shingles", "component_id")


def _linked(docs: DataFrame, nodes: DataFrame | None, width: int, percent: int, part_rows: int) -> DataFrame:
    spark = docs.sparkSession
    profiles = written(_profiles(docs, width), "profiles")
    members = profiles.filter("block IS NULL").select("doc_id", "n", "key1", "key2")
    first = members.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("class"))
    classes = written(members.join(first, ["n", "key1", "key2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class")), "classes")

    near = Window.partitionBy("gram", "part").orderBy(F.desc("centre"), "doc_id")
    seen = _prefixes(docs, width, percent, _sketch(profiles), part_rows)
    pivot = F.first(F.struct("doc_id", "n", "place")).over(near.rowsBetween(Window.unboundedPreceding, 0))
    # A group of two has no other pair than the one with its pivot; only larger ones are looked at again.
    groups = seen.withColumn("pivot", pivot).withColumns({"rank": F.row_number().over(near), "second": F.lead("doc_id").over(near), "third": F.lead("doc_id", 2).over(near)})
    groups = groups.withColumn("large", (F.col("part") >= 0) | (F.col("rank") > 2) | ((F.col("rank") == 2) & F.col("second").isNotNull()) | F.col("third").isNotNull())
    groups = written(groups.filter("rank > 1 OR large").select("gram", "doc_id", "n", "place", "part", "pivot", "large"), "groups")
    release(spark)

    ids = classes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("class"))

    counts = profiles.filter("block IS NULL AND n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "counts").dropDuplicates(["doc_id"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(_possible(pairs, counts.join(_ends(pairs), "doc_id", "left_semi"), percent), "possible")
        found = written(_verified(pairs, written(_sets(docs, width, written(_ends(pairs), "ends")), "sets"), percent), "links")
        release(spark)
        return found

    def of_classes(pairs: DataFrame) -> DataFrame:
        named = pairs.join(ids.select(F.col("doc_id").alias("a"), F.col("class").alias("a2")), "a")
        named = named.join(ids.select(F.col("doc_id").alias("b"), F.col("class").alias("b2")), "b")
        return named.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()

    heads = groups.filter("part >= 0 AND pivot.doc_id = doc_id").select("gram", "doc_id", "n", "place")
    heads = heads.withColumn("pivot", F.first(F.struct("doc_id", "n", "place")).over(Window.partitionBy("gram").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    to_pivot = groups.select("doc_id", "n", "place", "pivot").unionByName(heads.drop("gram")).filter("pivot.doc_id <> doc_id").filter(_may_link("n", "place", "pivot.n", "pivot.place", percent))
    tried = written(of_classes(to_pivot.select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")).distinct()), "pairs")
    links = verified(tried)

    named = components(links)
    parts = written(ids.join(named.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "class", F.coalesce("component", "class").alias("part")), "parts")
    rest = groups.filter("large").select("gram", "doc_id", "n", "place").join(parts, "doc_id").select("gram", "class", "n", "place", "part")
    split = rest.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members"))
    split = written(split.filter("low < high").select("gram", "members"), "split")
    release(spark)
    rest = written(rest.join(split, "gram").distinct(), "rest")
    release(spark)
    more = verified(written(_across(rest, percent).join(tried, ["a", "b"], "left_anti"), "pairs"))

    copies = ids.filter("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    if nodes is not None:
        copies = copies.unionByName(nodes.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    final = components(links.unionByName(more).unionByName(copies))
    joined = classes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
