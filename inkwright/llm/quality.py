"""Quality rules with thresholds from mergeable quantile sketches, with DataFrame expressions only.

A text's counts (characters in words, symbols, repeated lines, words in repeated windows) become rates per thousand words. Each
rate has a sketch per language and source: counts of values in buckets whose width is at most 1/32 of the value. Sketches add up exactly, in
any order, so those of a language, and of all rows, are sums of the small ones, and the corpus is read for them once.

A group's thresholds are fences around its quartiles: a rate may lie `reach` interquartile ranges (of at least the rule's `spread`) beyond
them, and a text may exceed that by the rule's `slack` in counts, so that one odd token does not condemn a short text. A group with fewer than
LEAST_ROWS rows takes the fences of its language, or of all rows. Texts that fail the fixed base rules are in no sketch.

Repeated windows are found by 64-bit hashes of five words, sorted within the text; two different windows of one text share a
hash with a chance below n^2 / 2^65.

Null or empty text has no words, fails the base and is not kept. Null lang or source is a group of its own. Repeated rows are judged alike
and all count. An empty table gives an empty result. Columns of any other name are carried by clean_documents() and never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

WIDTH, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "[#*$%&|<>]+"
_SPACE = r"[\x20\x09-\x0D]+"
#: Values below this are counted exactly, larger ones with their highest bits only.
EXACT, _BITS = 64, 6
#: Rows that a group's own thresholds need, and parts that its rows are dealt over when thresholds are joined.
LEAST_ROWS, SALTS = 200, 32


@dataclass(frozen=True)
class Rule:
    """A count whose rate per thousand words is held against fences; `both`: also too low a rate fails."""

    count: str
    spread: int
    slack: int
    both: bool = False


REACH = 3
RULES = (Rule("word_chars", 250, 60, both=True), Rule("n_symbols", 30, 3), Rule("n_dup_lines", 30, 2), Rule("n_repeat_words", 60, 10))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """Add __q_n_words, __q_word_chars, __q_n_symbols, __q_n_dup_lines and __q_n_repeat_words of the column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__q_w", F.array_remove(F.split(text, _SPACE), ""))
    out = out.withColumn("__q_l", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__q_w")
    hashes = F.transform("__q_w", lambda w: F.xxhash64(w))
    out = out.withColumns({
        "__q_n_words": n.cast("long"),
        "__q_word_chars": F.length(F.array_join("__q_w", "")).cast("long"),
        "__q_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "__q_n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
        "__q_h": hashes,
    }).drop("__q_w", "__q_l")
    window = lambda i: F.xxhash64(*(F.get("__q_h", i + k) for k in range(WIDTH)))
    out = out.withColumn("__q_g", F.when(F.size("__q_h") >= WIDTH, F.transform(F.sequence(F.lit(0), F.size("__q_h") - WIDTH), window)).otherwise(F.array().cast("array<bigint>"))).drop("__q_h")
    # Only texts with an equal pair are sorted.
    repeats = F.size(F.array_distinct("__q_g")) < F.size("__q_g")
    placed = F.array_sort(F.transform("__q_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("__q_s", F.when(repeats, placed)).drop("__q_g")
    twice = F.filter("__q_s", lambda x, i: (x["g"] == F.get("__q_s", i - 1)["g"]) | (x["g"] == F.get("__q_s", i + 1)["g"]))
    # get() of a place outside the array is null, and null or true is true.
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    grown = lambda s, i: F.struct((i + WIDTH).alias("end"), (s["n"] + WIDTH - F.greatest(F.lit(0), s["end"] - i)).alias("n"))
    covered = F.aggregate(places, start, grown, lambda s: s["n"])
    return out.withColumn("__q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__q_s")


def base_failed() -> Column:
    n, repeated = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def bucket(value: Column) -> Column:
    """Lowest value of the bucket of a non-negative long."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - _BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(counts: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the rates of all rows that pass the base, in one pass."""
    rates = F.array(*(F.struct(F.lit(k).alias("rule"), bucket(F.expr(f"1000 * __q_{r.count} div __q_n_words")).alias("bucket")) for k, r in enumerate(RULES)))
    rows = counts.filter(~base_failed()).select("lang", "source", F.explode(rates).alias("r")).select("lang", "source", "r.rule", "r.bucket")
    return rows.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return parts.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, low_k and high_k of every rule k, from the quartiles of the groups' sketches."""
    group = Window.partitionBy(*keys, "rule")
    run = parts.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group)})
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    ends = run.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), quartile(1).alias("a"), quartile(3).alias("b"))
    columns = [F.max("rows").alias("rows")]
    for k, rule in enumerate(RULES):
        wide = F.greatest(F.col("b") - F.col("a"), F.lit(rule.spread)) * REACH
        columns += [F.max(F.when(F.col("rule") == k, F.col("a") - wide)).alias(f"low_{k}"), F.max(F.when(F.col("rule") == k, F.col("b") + wide)).alias(f"high_{k}")]
    return ends.groupBy(*keys).agg(*columns)


def thresholds(parts: DataFrame) -> DataFrame:
    """Fences of every (lang, source): its own, else its language's, else those of all rows."""
    named = [f"{side}_{k}" for k in range(len(RULES)) for side in ("low", "high")]
    own = fences(parts, ["lang", "source"])
    lang = fences(merged(parts, ["lang"]), ["lang"]).select(F.col("lang").alias("l_lang"), F.col("rows").alias("l_rows"), *(F.col(c).alias(f"l_{c}") for c in named))
    every = fences(merged(parts, []), []).select(*(F.col(c).alias(f"a_{c}") for c in named))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(every))  # one row
    pick = lambda c: F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return both.select("lang", "source", *(pick(c).alias(c) for c in named))


def _within(k: int, rule: Rule) -> Column:
    rate, n = 1000 * F.col(f"__q_{rule.count}"), F.col("__q_n_words")
    above = rate <= F.col(f"__q_high_{k}") * n + 1000 * rule.slack
    return above & (rate >= F.col(f"__q_low_{k}") * n - 1000 * rule.slack) if rule.both else above


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Add __q_base_failed and __q_kept to counted rows, by a join with the thresholds (a written table).

    Spark broadcasts it if its files are small enough; else rows and thresholds meet by group and salt, so no group is one task's.
    """
    names = [f"{side}_{k}" for k in range(len(RULES)) for side in ("low", "high")]
    limits = limits.select(F.struct("lang", "source").alias("__q_group"), *(F.col(c).alias(f"__q_{c}") for c in names), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__q_part"))
    salt = F.pmod(F.xxhash64(*(f"__q_{c}" for c in COUNTS)), F.lit(SALTS)).cast("int")
    rows = counts.withColumns({"__q_salt": salt, "__q_base_failed": base_failed()})
    same = F.struct("lang", "source").eqNullSafe(F.col("__q_group")) & (F.col("__q_salt") == F.col("__q_part"))
    joined = rows.join(limits, same, "left")
    fine = reduce(lambda a, b: a & b, (_within(k, rule) for k, rule in enumerate(RULES)))
    return joined.withColumn("__q_kept", ~F.col("__q_base_failed") & F.coalesce(fine, F.lit(False))).drop("__q_salt", "__q_group", "__q_part", *(f"__q_{c}" for c in names))


def _counts_and_limits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = written(counted(docs.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    return counts, written(thresholds(written(sketch(counts), "sketches")), "thresholds")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row."""
    counts, limits = _counts_and_limits(docs)
    return judged(counts, limits).select("doc_id", *(F.col(f"__q_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with their own columns."""
    limits = _counts_and_limits(docs)[1]
    return judged(counted(docs), limits).filter("__q_kept").select(*docs.columns)
