"""Merkle manifest of a dataset: a tree a group, a tree over the groups, and a proof for every row.

A row's leaf is the digest of its columns; within a group leaves ascend by key. Every `fanout` consecutive nodes become the
digest of their concatenated hexadecimal digests; a last run may be shorter and is not padded. What remains is the group's root, and
the roots, ordered by group, become the root of the dataset in the same way.

1. Leaves are computed where the rows are read; only digests travel. They are range-partitioned by (group, key) and numbered, and
   cut into units of at most `fanout` ** HEIGHT leaves with the group's index of their first one.
2. A unit keeps a mountain range: a stack with one open run a level. A leaf that completes a run carries into the level above, and so on;
   runs that began in an earlier unit or go on in the next can't be completed and end as peaks, a few a level.
3. Peaks of all units are merged by aligned blocks of HEIGHT levels, a round for each: a block's peaks meet in one task, are pushed
   on the same stack in order, and leave one node. A round's result is a written table.
4. Units are read once more with the paths of their peaks and give every leaf its siblings up to the root.

No group is gathered: a task holds a unit or a block's peaks, whatever share of the rows a group, key or row has.

Nulls have a mark of their own in a leaf; null groups and keys come first. Rows with equal keys are ordered by their leaves, so
repeated rows are leaves of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

FANOUT = 2
#: Leaves of a unit and, as levels, of a block: the largest power of the fanout up to this.
UNIT_ROWS = 1 << 15
_NODE = "tree string, part long, unit long, first long, total long, level int, index long, digest string"
_CLIMB = "tree string, level int, index long, path string, to_level int, to_index long, digest string, total long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """Digest of a row's columns: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    marked = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*marked), 256)


class MountainRange:
    """Nodes pushed in order of their places; completed runs carry, what can't be completed ends as a peak."""

    def __init__(self, total: int, fanout: int, top: int | None = None):
        self.fanout, self.sizes = fanout, [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.top = len(self.sizes) - 1 if top is None else min(top, len(self.sizes) - 1)
        self.open: list[list[tuple[int, str]]] = [[] for _ in self.sizes]
        self.nodes: dict[tuple[int, int], str] = {}
        self.peaks: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, value: str) -> None:
        while True:
            run = self.open[level]
            run.append((index, value))
            self.nodes[level, index] = value
            ends = (index + 1) % self.fanout == 0 or index + 1 == self.sizes[level]
            if level < self.top and not ends:
                return
            if level == self.top or run[0][0] % self.fanout:
                self._left(level)
                return
            value, level, index = digest(*(d for _, d in run)), level + 1, index // self.fanout
            run.clear()

    def _left(self, level: int) -> None:
        self.peaks += [(level, *node) for node in self.open[level]]
        self.open[level].clear()

    def close(self) -> list[tuple[int, int, str]]:
        for level in range(len(self.open)):
            self._left(level)
        return self.peaks

    def path(self, level: int, index: int) -> tuple[str, int, int]:
        """Siblings of every level from a node up to its peak, as `left,right` joined by `;`, and the peak's place."""
        steps = []
        while (level + 1, index // self.fanout) in self.nodes:
            first = index - index % self.fanout
            run = [self.nodes[level, i] for i in range(first, min(first + self.fanout, self.sizes[level]))]
            steps.append("".join(run[: index - first]) + "," + "".join(run[index - first + 1 :]))
            level, index = level + 1, index // self.fanout
        return ";".join(steps), level, index


def folded(start: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for step in path.split(";") if path else ():
        left, right = step.split(",")
        start = digest(left, start, right)
    return start


def siblings(path: str) -> str:
    """All siblings of a path, level by level, left to right."""
    return path.replace(";", "").replace(",", "")


def _height(fanout: int) -> int:
    if fanout < 2:
        raise ValueError("a fanout of 2 at least")
    return max(1, int(math.log(UNIT_ROWS, fanout) + 1e-9))


def _numbered(leaves: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """Leaves (a written table) in order, with part, unit and place: `at` within the part."""
    rows, size = leaves.count(), fanout ** _height(fanout)
    parts = max(partitions(leaves.sparkSession), -(-rows // size))
    ordered = leaves.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())  # the partition and the place in it
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    ordered = ordered.withColumns({"part": F.shiftright("_id", 33), "at": at, "unit": F.floor(at / size)})
    return written(ordered.drop("_id"), "units")


def _infos(units: DataFrame) -> DataFrame:
    """tree, part, unit, first (index in the tree of a unit's first leaf) and total (leaves of the tree)."""
    counts = units.groupBy("tree", "part", "unit").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part", "unit").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("tree", "part", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))


def _ranged(rows: pd.DataFrame, first: int, total: int, fanout: int) -> MountainRange:
    out = MountainRange(int(total), fanout)
    for k, value in enumerate(rows.sort_values("at")["leaf"]):
        out.push(0, int(first) + k, value)
    out.close()
    return out


def _peaks(units: DataFrame, fanout: int) -> DataFrame:
    keys = ["tree", "part", "unit"]

    def run(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in _NODE.split(", ")])
        tree, part, unit, first, total = info[[*keys, "first", "total"]].iloc[0]
        found = _ranged(rows, first, total, fanout).peaks
        return pd.DataFrame([(tree, part, unit, first, total, *p) for p in found], columns=[c.split()[0] for c in _NODE.split(", ")])

    return written(units.select(*keys, "at", "leaf").groupBy(*keys).cogroup(_infos(units).groupBy(*keys)).applyInPandas(run, _NODE), "peaks")


def _climbed(peaks: DataFrame, fanout: int) -> DataFrame:
    """tree, level, index, path and root of every peak: its siblings up to the root of its tree."""
    height, largest = _height(fanout), peaks.agg(F.max("total")).first()[0] or 1
    nodes, rounds, top = peaks.select("tree", "level", "index", "digest", "total"), [], 0

    def merge(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            tree, total = rows["tree"].iloc[0], int(rows["total"].iloc[0])
            out = MountainRange(total, fanout, top)
            places = sorted((i * fanout**k, int(k), int(i), d) for k, i, d in zip(rows["level"].astype(object), rows["index"].astype(object), rows["digest"]))
            for _, level, index, value in places:
                out.push(level, index, value)
            out.close()
            found = [(tree, level, index, *out.path(level, index)) for _, level, index, _ in places]
            return pd.DataFrame([(*f, out.nodes[f[4], f[5]], total) for f in found], columns=[c.split()[0] for c in _CLIMB.split(", ")])

        return run

    while not rounds or fanout**top < largest:
        top += height
        block = F.expr(f"index div cast(pow({fanout}, greatest(0, {top} - level)) as long)")
        rounds.append(written(nodes.withColumn("block", block).groupBy("tree", "block").applyInPandas(merge(top), _CLIMB), "climb"))
        nodes = rounds[-1].select("tree", F.col("to_level").alias("level"), F.col("to_index").alias("index"), "digest", "total").distinct()
    final = rounds[-1].select("tree", "level", "index", "path", F.col("digest").alias("root"))
    for lower in reversed(rounds[:-1]):
        above = final.select("tree", F.col("level").alias("to_level"), F.col("index").alias("to_index"), F.col("path").alias("rest"), "root")
        final = lower.join(above, ["tree", "to_level", "to_index"]).select("tree", "level", "index", _joined("path", "rest").alias("path"), "root")
    return final


def _joined(*paths: str) -> Column:
    return F.concat_ws(";", *(F.when(F.col(p) != "", F.col(p)) for p in paths))


def _walked(units: DataFrame, upper: DataFrame, fanout: int, kept: list[str], emit: Callable[[pd.DataFrame, Iterator], pd.DataFrame], schema: str) -> DataFrame:
    """emit(rows of a unit in order, (path, upper row) of each) for every unit; upper: a row for every peak, as from _peaks with its path."""
    keys = ["tree", "part", "unit"]

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        if rows.empty:
            return emit(rows, iter(()))
        first = int(above["first"].iloc[0])
        out = _ranged(rows, first, above["total"].iloc[0], fanout)
        by_peak = {(int(r.level), int(r.index)): r for r in above.rename_axis("row").itertuples(index=False)}

        def paths() -> Iterator[tuple]:
            for k in range(len(rows)):
                path, level, index = out.path(0, first + k)
                peak = by_peak[level, index]
                yield ";".join(p for p in (path, peak.path) if p), peak

        return emit(rows, paths())

    return units.select(*keys, "at", *kept).groupBy(*keys).cogroup(upper.groupBy(*keys)).applyInPandas(run, schema)


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaf, subroot, root, proof and the root folded from `altered` of every row.

    `rows` has key, grp (the group, a string), leaf and altered (the leaf that is presented; the same one if all is well).
    """
    spread = F.xxhash64(F.monotonically_increasing_id())  # parts rows that are alike in everything
    tree = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))
    leaves = written(rows.select(tree.alias("tree"), "key", "leaf", "altered", spread.alias("tie")), "leaves")
    units = _numbered(leaves, ["key", "leaf", "altered", "tie"], fanout)
    peaks = _peaks(units, fanout)
    climbed = written(_climbed(peaks, fanout), "paths")

    tops = written(climbed.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")).distinct(), "subroots")
    top_units = _numbered(tops, ["name"], fanout)
    top_peaks = _peaks(top_units, fanout)
    top_upper = top_peaks.drop("digest").join(_climbed(top_peaks, fanout), ["tree", "level", "index"])

    def of_groups(rows: pd.DataFrame, paths: Iterator) -> pd.DataFrame:
        found = [(name, sub, path, peak.root) for name, sub, (path, peak) in zip(rows["name"], rows["leaf"], paths)]
        return pd.DataFrame(found, columns=["tree", "subroot", "rest", "root"])

    groups = written(_walked(top_units, top_upper, fanout, ["name", "leaf"], of_groups, "tree string, subroot string, rest string, root string"), "groups")
    upper = peaks.drop("digest").join(climbed.drop("root"), ["tree", "level", "index"]).join(groups, "tree")
    upper = upper.withColumn("path", _joined("path", "rest")).drop("rest")

    def of_rows(rows: pd.DataFrame, paths: Iterator) -> pd.DataFrame:
        found = [(key, own, peak.subroot, peak.root, digest(siblings(path)), folded(shown, path)) for key, own, shown, (path, peak) in zip(rows["key"], rows["leaf"], rows["altered"], paths)]
        frame = pd.DataFrame(found, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
        return frame.assign(key=frame["key"].astype("string"))

    # As text, a key needs no float for the nulls beside it.
    units = units.withColumn("key", F.col("key").cast("string"))
    out = _walked(units, upper, fanout, ["key", "leaf", "altered"], of_rows, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    kind = rows.schema["key"].dataType
    return out.select(F.col("key").cast(kind).alias("key"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """The manifest of documents by lang and doc_id; rows where `tampered` holds present a leaf with one more in n_chars."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    own = leaf(*columns)
    changed = leaf(*columns[:3], F.col("n_chars") + 1, columns[4])
    altered = own if tampered is None else F.when(tampered & F.col("n_chars").isNotNull(), changed).otherwise(own)
    rows = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), own.alias("leaf"), altered.alias("altered"))
    return manifest(rows, fanout).withColumnRenamed("key", "doc_id")
