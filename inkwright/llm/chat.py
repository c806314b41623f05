"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each one conversation.

Paths come from iterative self-joins on ids alone. Pointer doubling gives each message its ancestor
at distance 1, 2, 4, ...; from the leaves, joins with these tables from the widest step to the
narrowest give every ancestor once. A tree of depth d takes about log2(d) rounds of joins either way,
and nothing is larger than the paths. Texts join once, at the end.

A message without a parent, or whose parent is not in the table, is a root. Messages on a cycle
have no root and so no path. Null text and null role are empty; a null score counts as 0. Among equal scores
the longer path, then the smaller leaf id, ranks first. An empty table gives no conversation.

The template marks turns as "### role:\\n" text "\\n</turn>\\n". Inside roles and texts a backslash is
doubled and a control string gets one in front, so the output reads back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Fixed strings of the template.
OPEN, CLOSE, END = "### ", ":\n", "\n</turn>\n"
CONTROLS = ("### ", "</turn>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")")
_TOKEN = re.compile(r"\\.|### |</turn>|:\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (code points) of the texts in the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace(":", "\\:") + CLOSE
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns, role, at, place = [], "", 0, "between"
    for m in _TOKEN.finditer(formatted):
        if place == "between" and m[0] == OPEN:
            place, at = "role", m.end()
        elif place == "role" and m[0] == CLOSE:
            role, place, at = unescape(formatted[at : m.start()]), "text", m.end()
        elif place == "text" and m[0] == "</turn>":
            turns.append((role, unescape(formatted[at : m.start() - 1])))
            place = "between"
    return turns


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, tree, score, depth) of every root-to-leaf path, and tables (node, up) of ancestors 1, 2, 4, ... steps up.

    `messages` (tree, node, parent, score) is read once for every join, so give a written table. In round k a
    node's row sums up the node and its next 2^k - 1 ancestors, so no path is spelled out here, and a tree of
    any shape takes one row for each node and round.
    """
    known = messages.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    table = written(messages.join(known, "parent", "left").select("node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "rounds")
    leaves = messages.select(F.col("node").alias("leaf"), "tree").join(table.select(F.col("up").alias("leaf")), "leaf", "left_anti")
    bound, steps = max(1, messages.count()).bit_length(), []
    while len(steps) <= bound and not table.filter("up IS NOT NULL").isEmpty():
        steps.append(table.filter("up IS NOT NULL").select("node", "up"))
        above = table.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("total").alias("t"), F.col("depth").alias("d"))
        zero = F.lit(0)
        table = written(table.join(above, "up", "left").select("node", F.col("further").alias("up"), (F.col("total") + F.coalesce("t", zero)).alias("total"), (F.col("depth") + F.coalesce("d", zero)).alias("depth")), "rounds")
    # An ancestor further up than there are messages: the way leads into a cycle, which is no path.
    ends = table.filter("up IS NULL").select(F.col("node").alias("leaf"), F.col("total").alias("score"), "depth")
    return leaves.join(ends, "leaf"), steps


def paths(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(leaf, node, distance) for each of the leaves and all their ancestors, the leaf itself at 0."""
    found = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(steps))):
        more = found.join(steps[k], "node").select("leaf", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        found = written(found.unionByName(more), "paths")  # else each round would double the plan
    return found


def conversations(messages: DataFrame, keep: int = 1, learn: str = "assistant") -> DataFrame:
    """The `keep` best paths of each tree, formatted: tree, leaf, rank, score, formatted, spans.

    `messages`: tree, node, parent, score double, role, text. Paths are ranked by score, then depth; only those kept are spelled out.
    """
    small_batches(messages.sparkSession)
    ids = written(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    scored, steps = branches(ids)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf"))
    chosen = written(scored.withColumn("rank", rank).filter(F.col("rank") <= keep), "chosen")
    links = paths(chosen, steps)
    texts = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = links.join(texts, "node")
    grouped = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("place"), "role", "text"))).alias("turns"))
    rows = grouped.join(chosen, "leaf").select("tree", "leaf", "rank", "score", "turns")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in batch["turns"]]
            yield batch.drop(columns="turns").assign(formatted=[m[0] for m in made], spans=[[{"start": a, "stop": b} for a, b in m[1]] for m in made])

    kind = dict(rows.dtypes)
    return rows.mapInPandas(render, f"tree {kind['tree']}, leaf {kind['leaf']}, rank int, score double, formatted string, spans array<struct<start:long,stop:long>>")


def chains(turns: DataFrame) -> DataFrame:
    """Messages of a table of turns: each turn replies to the one before it. Repeated turns are turns of their own."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = turns.select("conv_id", "role", "text", order.alias("n"), name.alias("name"))
    parent = F.when(F.col("n") > 1, F.concat_ws(":", "name", F.col("n") - 1))
    return rows.select(F.col("conv_id").alias("tree"), F.concat_ws(":", "name", "n").alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it: turns by parsing, learned text by its mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, null, text, spans in zip(batch["conv_id"], batch["null_id"], batch["formatted"], batch["spans"]):
                turns = parse_turns(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((None if null else int(conv_id), len(turns), sha(told), len(learned), sha(learned), len(text)))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))

    rows = formatted.select(F.coalesce(F.col("tree"), F.lit(0)).alias("conv_id"), F.col("tree").isNull().alias("null_id"), "formatted", "spans")
    return rows.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
