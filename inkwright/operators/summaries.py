"""Outline, style, tag and summary operators over sections and sentences."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import bound, occurrences, sentences
from .spread import spread


def outline_ratios(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, title, n, ratio): words of each section and its share of the document."""
    n = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    rows = sections.withColumn("n", n)
    total = F.sum("n").over(Window.partitionBy(key))
    return rows.withColumn("ratio", F.when(total > 0, F.col("n") / total).otherwise(0.0)).select(key, "section", "title", "n", "ratio")


def outline_issues(ratios: DataFrame, required: list[str], key: str = "doc_id", short: float = 0.05, long: float = 0.60, least: int = 1200) -> DataFrame:
    """(key, issue, section): sections other than references that are too short or too long, documents that are short, required sections that miss."""
    parts = ratios.filter((F.lower("title") != "references") & ((F.col("ratio") < short) | (F.col("ratio") > long)))
    uneven = parts.select(key, F.when(F.col("ratio") < short, "section_too_short").otherwise("section_too_long").alias("issue"), F.col("title").alias("section"))
    docs = ratios.groupBy(key).agg(F.sum("n").alias("n"), F.collect_set(F.lower("title")).alias("names"))
    length = docs.filter(F.col("n") < least).select(key, F.lit("length_warning").alias("issue"), F.lit(None).cast("string").alias("section"))
    absent = docs.select(key, F.explode(F.array_except(F.array(*map(F.lit, required)), "names")).alias("section")).select(key, F.lit("missing_section").alias("issue"), "section")
    return uneven.unionByName(length).unionByName(absent)


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(sentences(F.coalesce(text, F.lit("")))).alias("place", "sentence"))


#: Words that make a sentence of a paper telling.
SUMMARY_WORDS = ("研究", "本文", "主要", "核心", "关键", "结论", "提出", "认为", "分析", "证明", "发现", "表明", "讨论", "探讨", "论述", "论证", "观点", "理论")
_STOPS = "[。！？；\n]+"


def extractive_summary(docs: DataFrame, keywords: tuple[str, ...] = SUMMARY_WORDS, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary): the k best sentences in text order, with spaces between; a text with no more than k stays as it is.

    A sentence ends at 。！？； or a line end. It has 0.5 if it is one of the first three, 0.3 if one of the last two, 0.1 for each keyword in it, and 0.1
    above 50 characters; 1 at most. Ties go to the earlier one. A null text is empty.
    """
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), _STOPS), lambda s: F.regexp_replace(s, r"^[\s　]+|[\s　]+$", ""))
    docs = docs.select(key, F.coalesce(text, F.lit("")).alias("_t"), F.filter(parts, lambda s: s != "").alias("_s"))
    rows = docs.filter(F.size("_s") > k).select(key, F.size("_s").alias("_n"), F.posexplode("_s").alias("place", "sentence"))
    words = sum((F.contains("sentence", F.lit(w)).cast("int") for w in keywords), F.lit(0))
    score = F.when(F.col("place") < 3, 0.5).otherwise(0.0) + F.when(F.col("place") >= F.col("_n") - 2, 0.3).otherwise(0.0) + words * 0.1 + F.when(F.length("sentence") > 50, 0.1).otherwise(0.0)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    best = rows.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("place", "sentence")))
    cut = best.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("summary"))
    return cut.unionByName(docs.filter(F.size("_s") <= k).select(key, F.col("_t").alias("summary")))


def tags(text: Column, categories: dict[str, list[str]], most: int = 10) -> Column:
    """(weight, name, category) of the tags that occur, heaviest first: occurrences as written plus in lower case, times 1.5 if the first 500 characters hold it."""
    lower = F.lower(text)
    found = []
    for category, names in categories.items():
        for name in names:
            count = occurrences(text, F.lit(name)) + occurrences(lower, F.lit(name.lower()))
            weight = count * F.when(F.contains(F.substring(text, 1, 500), F.lit(name)), 1.5).otherwise(1.0)
            found.append(F.struct((-weight).alias("order"), F.lit(name).alias("name"), F.lit(category).alias("category"), weight.alias("weight")))
    kept = F.filter(F.array(*found), lambda t: t["weight"] > 0)
    return F.transform(F.slice(F.array_sort(kept), 1, most), lambda t: F.struct(t["weight"].alias("weight"), t["name"].alias("name"), t["category"].alias("category")))


def sentence_shape(text: Column, connectors: list[str]) -> Column:
    """mean sentence length, shares of long (60 or more) and short (20 or fewer) ones, connectors per sentence."""
    used = sum((occurrences(text, F.lit(c)) for c in connectors), F.lit(0))

    def shape(lengths: Column) -> Column:
        n = F.greatest(F.size(lengths), F.lit(1))
        return F.struct(
            (F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / n).alias("mean_length"),
            (F.size(F.filter(lengths, lambda x: x >= 60)) / n).alias("long_share"),
            (F.size(F.filter(lengths, lambda x: x <= 20)) / n).alias("short_share"),
            (used / n).alias("connector_density"),
        )

    return bound(F.transform(sentences(text), lambda s: F.length(s)), shape)


def style_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two sentence shapes, lengths on a scale of 100."""
    parts = [F.abs(a["mean_length"] - b["mean_length"]) / 100] + [F.abs(a[c] - b[c]) for c in ("long_share", "short_share", "connector_density")]
    return sum(parts, F.lit(0.0)) / len(parts)


def reading_minutes(text: Column, per_minute: int = 400) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / per_minute)).cast("int")


def reading_difficulty(text: Column) -> Column:
    """easy, medium (over five terms) or difficult (over ten); terms stand in 《》, ［］ or parentheses.

    The other measure, length in sentences over length of the text, is 1 at most and its limits are 30 and 50: it decides nothing.
    """
    terms = F.regexp_count(text, F.lit(r"《[^》]+》|［[^］]+］|\([^) ]+\)"))
    return F.when(terms > 10, "difficult").when(terms > 5, "medium").otherwise("easy")


@F.pandas_udf(ArrayType(DoubleType()))
def word_frequency(texts: pd.Series, parts: pd.Series) -> pd.Series:
    """Of each part, half the mean number of times that its words of two letters or more stand in the text; null without a word."""
    word, out = re.compile(r"\w+", re.ASCII), []
    for text, listed in zip(texts, parts):
        times = Counter(w for w in word.findall(text) if len(w) > 1)
        found = [word.findall(p) for p in listed]
        out.append([sum(times[w] for w in ws) / (len(ws) * 2) if ws else None for ws in found])
    return pd.Series(out)


def sentence_importance(docs: DataFrame, key: str, text: str, keywords: list[str]) -> DataFrame:
    """(key, place, sentence, score, category): a quarter position, 0.35 keywords, 0.15 length, a quarter frequency of the words in the whole text.

    Words are counted in the row of their text; nothing is shuffled.
    """
    found = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"([^.!?]+[.!?])"), 1), lambda s: F.btrim(s, F.lit(" \t\n\v\f\r"))), lambda s: F.length(s) > 0)
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.lower(text).alias("_t"), found.alias("_s")).filter(F.size("_s") > 0)
    rows = rows.withColumn("_f", word_frequency("_t", F.transform("_s", F.lower)))
    rows = rows.select(key, F.size("_s").alias("n"), F.posexplode(F.arrays_zip("_s", "_f")).alias("place", "_x")).select(key, "n", "place", F.col("_x._s").alias("sentence"), F.col("_x._f").alias("_f"))
    place, n, size, low = F.col("place"), F.col("n"), F.length("sentence"), F.lower("sentence")
    position = F.when(place < 3, 1.0).when(place < n * 0.2, 0.8).when(place > n * 0.8, 0.7).otherwise(0.5)
    hits = sum((F.when(F.contains(low, F.lit(k)), 0.2).otherwise(0.0) for k in keywords), F.lit(0.0))
    length = F.when(size.between(50, 200), 1.0).when(size.between(30, 300), 0.7).otherwise(0.4)
    kinds = {"purpose": "目的|aim|本研究旨在", "method": "方法|method", "result": "结果|result|結果|发现", "conclusion": "结论|conclusion|結論|综上"}
    category = F.coalesce(*[F.when(low.rlike(p), k) for k, p in kinds.items()], F.lit("content"))
    score = position * 0.25 + F.least(hits, F.lit(1.0)) * 0.35 + length * 0.15 + F.least(F.coalesce("_f", F.lit(0.0)), F.lit(1.0)) * 0.25
    return rows.select(key, "place", "sentence", score.alias("score"), category.alias("category"))


def term_profile(docs: DataFrame, key: str, words: Column, most: int = 10) -> DataFrame:
    """(key, token_count, terms): all tokens, and the `most` most frequent ones of two characters or more, the earlier one first where equal."""
    # Texts are dealt by key once; words are counted and ranked where their text lies.
    tokens = spread(docs, key).select(key, F.posexplode(words).alias("_at", "_word"))
    counted = tokens.groupBy(key, "_word").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    best = Window.partitionBy(key).orderBy(F.length("_word") < 2, F.desc("_n"), "_at")
    top = F.when((F.col("_r") <= most) & (F.length("_word") >= 2), F.struct("_r", "_word", "_n"))
    terms = F.transform(F.array_sort(F.collect_list(top)), lambda s: F.struct(s["_word"].alias("term"), s["_n"].alias("n")))
    out = counted.withColumn("_r", F.row_number().over(best)).groupBy(key).agg(F.sum("_n").alias("token_count"), terms.alias("terms"))
    return out.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")))
