"""Configured sources and equivalents: rules as tables, met by containment without pairing all with all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.cleanup import source_key
from .dedup import keep_first
from .evidence import nfkc

_MARKS = r"[\s　・:：,，.。;；、\-‐‑–—_()（）\[\]【】『』「」]+"
#: Endings of a volume's title that do not tell sources apart, in this order.
VOLUME_ENDINGS = (r"(第?[0-9０-９一二三四五六七八九十百]+(巻|卷|冊|册|編|篇|集|号|號))$", "(上巻|下巻|中巻|前編|後編|別巻|総目録|索引)$")


#: Rules without terms that fit every citation: so many at most.
MOST_GENERAL = 1_000


def rule_key(text: Column) -> Column:
    """Lower case, compatibility forms, one form of variant characters, no marks or spaces."""
    return source_key(nfkc(F.coalesce(text, F.lit(""))))


def _terms(column: str = "terms") -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _with_each(citations: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, ord): every citation with every one of the rules, which are checked to be few."""
    rows = [r["ord"] for r in rules.select("ord").orderBy("ord").limit(MOST_GENERAL + 1).collect()]
    if len(rows) > MOST_GENERAL:
        raise ValueError(f"more than {MOST_GENERAL} rules fit every citation")
    kind = rules.schema["ord"].dataType
    return citations.select("id", F.explode(F.array(*[F.lit(r).cast(kind) for r in rows]).cast(ArrayType(kind))).alias("ord"))


def _grams(term: Column) -> Column:
    """All single characters and pairs of characters of a term."""
    size = F.length(term)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.substring(term, k, F.lit(2)))
    return F.array_distinct(F.concat(F.filter(F.split(term, ""), lambda c: c != ""), pairs))


def contained_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, term): terms of `right` (right_id, term) of which one side's term holds the other's, or that are equal, with `left` (left_id, term).

    The shorter term begins with a pair of characters that the longer one has somewhere, so terms meet by pairs: each side once as the shorter one.
    Terms are keys already; empty ones meet nothing.
    """
    left, right = (df.filter(F.length("term") > 0).distinct() for df in (left, right))
    named = lambda df, side: df.select(f"{side}_id", F.col("term").alias(f"{side}_term"))

    def met(short: str, long: str) -> DataFrame:
        sides = {"left": named(left, "left"), "right": named(right, "right")}
        s = sides[short].withColumn("gram", F.substring(f"{short}_term", 1, 2))
        held = sides[long].withColumn("gram", F.explode(_grams(F.col(f"{long}_term"))))
        return s.join(held, "gram").filter(F.contains(F.col(f"{long}_term"), F.col(f"{short}_term")))

    both = met("left", "right").unionByName(met("right", "left"))
    return both.select("left_id", "right_id", F.col("right_term").alias("term")).distinct()


def configured_ids(citations: DataFrame, items: DataFrame) -> DataFrame:
    """(id, source_id, hits, rank): sources configured for a citation, those with most matching terms first, then in order of configuration.

    citations: (id, terms); items: (section order `ord`, source_id, terms, is_default). An item without terms fits every citation; one with terms fits where
    one of them and one of the citation's hold each other, or, for a default, where the citation has no terms. A source counts once.
    """
    asked = citations.select(F.col("id").alias("left_id"), F.explode("terms").alias("term")).withColumn("term", rule_key(F.col("term")))
    rules = items.select(F.col("ord").alias("right_id"), F.explode("terms").alias("term")).withColumn("term", rule_key(F.col("term")))
    hits = contained_terms(asked, rules).groupBy(F.col("left_id").alias("id"), F.col("right_id").alias("ord")).agg(F.count("*").alias("hits"))
    always = _with_each(citations, items.filter(F.size(_terms()) == 0))
    default = _with_each(citations.filter(F.size(_terms()) == 0), items.filter(F.coalesce("is_default", F.lit(False)) & (F.size(_terms()) > 0)))
    fitting = hits.unionByName(always.unionByName(default).withColumn("hits", F.lit(0).cast("long")))
    named = fitting.join(items.select("ord", "source_id"), "ord").filter(F.coalesce("source_id", F.lit("")) != "")
    once = keep_first(named, ["id", "source_id"], [F.desc("hits"), "ord"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "ord"))
    return once.withColumn("rank", rank).select("id", "source_id", "hits", "rank")


def configured_documents(citations: DataFrame, items: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, items, source_ids, and for each kind its terms): documents configured for a citation, in order of configuration, with unions of their term lists.

    items: (ord, source_id, terms, and an array column for each kind).
    """
    asked = citations.select(F.col("id").alias("left_id"), F.explode("terms").alias("term")).withColumn("term", rule_key(F.col("term")))
    rules = items.select(F.col("ord").alias("right_id"), F.explode("terms").alias("term")).withColumn("term", rule_key(F.col("term")))
    hits = contained_terms(asked, rules).select(F.col("left_id").alias("id"), F.col("right_id").alias("ord")).distinct()
    fitting = hits.unionByName(_with_each(citations, items.filter(F.size(_terms()) == 0))).join(items, "ord")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    lists = [F.array_distinct(F.filter(F.flatten(F.filter(ordered(k), lambda a: a.isNotNull())), lambda v: F.coalesce(v, F.lit("")) != "")).alias(k) for k in kinds]
    ids = F.array_distinct(F.filter(ordered("source_id"), lambda v: F.coalesce(v, F.lit("")) != ""))
    return fitting.groupBy("id").agg(F.array_sort(F.collect_list("ord")).alias("items"), ids.alias("source_ids"), *lists)


def first_rule(rules: list[tuple[str, Column]], otherwise: str = "generic") -> Column:
    """Name of the first rule that holds; a rule that cannot be judged does not."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(False)), rule[0]).otherwise(rest), reversed(rules), F.lit(otherwise))


def title_base(title: Column) -> Column:
    """A title without marks and without the number or name of its volume."""
    text = F.regexp_replace(F.lower(nfkc(F.coalesce(title, F.lit("")))), _MARKS, "")
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), VOLUME_ENDINGS, text)


def equivalent_sources(candidates: DataFrame, matches: DataFrame, configured: DataFrame, most: int = 8) -> DataFrame:
    """(id, rank, source_id, scope, match_rank): sources with a candidate's title, or configured for it, where there are two at least.

    candidates: (id, title, host_title); matches: (id, ordinal from 0, source_id, title); configured: (id, ordinal, source_id). A host title stands for the
    title; without both the first match's title does. Matches come in their order, each source once, then configured ones that no match has.
    """
    named = matches.filter(F.coalesce("source_id", F.lit("")) != "")
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    first = named.groupBy("id").agg(F.min_by("title", "ordinal").alias("_first"))
    anchors = candidates.join(first, "id", "left").select("id", "title", title_base(F.coalesce(blank("host_title"), blank("title"), F.col("_first"))).alias("_base")).filter("_base <> ''")
    known = configured.select("id", "source_id").distinct().withColumn("_known", F.lit(True))
    rows = named.withColumn("_own", title_base(F.col("title"))).join(anchors.select("id", "_base"), "id").join(known, ["id", "source_id"], "left")
    fitting = keep_first(rows.filter((F.col("_own") == F.col("_base")) | F.col("_known")), ["id", "source_id"], ["ordinal"])
    found = fitting.select("id", "source_id", F.lit("match").alias("scope"), F.lit(0).alias("_list"), F.col("ordinal").cast("long").alias("_o"), (F.col("ordinal") + 1).cast("int").alias("match_rank"))
    rest = keep_first(configured, ["id", "source_id"], ["ordinal"]).join(anchors.select("id"), "id").join(found.select("id", "source_id"), ["id", "source_id"], "left_anti")
    both = found.unionByName(rest.select("id", "source_id", F.lit("configured").alias("scope"), F.lit(1).alias("_list"), F.col("ordinal").cast("long").alias("_o"), F.lit(None).cast("int").alias("match_rank")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_list", "_o", "source_id"))
    kept = both.withColumn("rank", rank).filter(F.col("rank") <= most)
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).filter("_n > 1").select("id", "rank", "source_id", "scope", "match_rank")
