"""Bibliographic and review records: scores, preferences, queries, facets, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_first
from .evidence import match_text, sequence_ratio


def record_scores(pairs: DataFrame) -> DataFrame:
    """score of records against footnotes: title, author, year, publisher and the record's r_title, r_author, r_year, r_publisher.

    0.7 times the ratio of titles; 0.15 more if one title holds the other, 0.1 for the author, 0.05 for the year, 0.03 for the
    publisher; 1 at most.
    """
    rows = pairs.withColumns({"_a": match_text(F.col("title")), "_b": match_text(F.col("r_title"))})
    held = (F.col("_a") != "") & (F.col("_b") != "") & (F.contains("_a", "_b") | F.contains("_b", "_a"))
    agrees = lambda a, b: (F.coalesce(a, F.lit("")) != "") & F.contains(F.coalesce(b, F.lit("")), a)
    score = sequence_ratio("_a", "_b") * 0.7 + F.when(held, 0.15).otherwise(0.0)
    for name, weight in (("author", 0.10), ("year", 0.05), ("publisher", 0.03)):
        score = score + F.when(F.coalesce(agrees(F.col(name), F.col(f"r_{name}")), F.lit(False)), weight).otherwise(0.0)
    return rows.withColumn("score", F.when(F.col("_a") == "", 0.0).otherwise(F.least(score, F.lit(1.0)))).drop("_a", "_b")


def plausible(score: Column, title: Column, least: float = 0.35) -> Column:
    """A record passes with a good enough score, or if there was no title to compare."""
    return (score >= least) | (F.coalesce(F.trim(title), F.lit("")) == "")


def plausible_or_best(matches: DataFrame, key: str, score: str, fallback: float = 0.20, least: float = 0.35) -> DataFrame:
    """Plausible matches of each key; where there are none, its first one at `fallback` or more, with a warning."""
    good = F.col(score) >= least
    some = F.max(good).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key, F.col(score) >= fallback).orderBy("ordinal"))
    rows = matches.withColumns({"_some": some, "_rank": rank})
    kept = rows.filter((F.col("_some") & good) | (~F.col("_some") & (F.col(score) >= fallback) & (F.col("_rank") == 1)))
    return kept.withColumn("fallback", ~F.col("_some")).drop("_some", "_rank")


def same_place(cid: Column, page: Column, cid2: Column, page2: Column) -> Column:
    """Equal id and page; what is unknown on either side agrees with anything."""
    alike = lambda a, b: a.isNull() | b.isNull() | (a == b)
    return alike(cid, cid2) & alike(page, page2)


def preferred_source(matches: DataFrame, key: str) -> DataFrame:
    """One match per key: with a PDF, else a digital id from another route than html, else a digital id, else any id, else the first."""
    digital = F.col("pid").rlike(r"^\d{7,}$")
    order = F.when(F.col("has_pdf"), 0).when(digital & (F.col("route") != "html"), 1).when(digital, 2).when(F.col("pid").isNotNull(), 3).otherwise(4)
    return keep_first(matches, [key], [order, "ordinal"])


def pages_per_scan(numbers: DataFrame, group: str) -> DataFrame:
    """(group, per_scan) from the page numbers seen on scans (group, scan, number): the upper median of steps between consecutive maxima, from 1 to 16."""
    scans = numbers.groupBy(group, "scan").agg(F.max("number").alias("top"), F.count("*").alias("n")).filter("n >= 2")
    window = Window.partitionBy(group).orderBy("scan")
    rows = scans.withColumns({"ds": F.col("scan") - F.lag("scan").over(window), "dp": F.col("top") - F.lag("top").over(window), "scans": F.count("*").over(Window.partitionBy(group))})
    step = F.bround(F.col("dp") / F.col("ds")).cast("int")
    steps = rows.filter("scans >= 3 AND ds > 0 AND dp > 0").withColumn("step", step).filter("step BETWEEN 1 AND 16")
    ordered = F.array_sort(F.collect_list("step"))
    return steps.groupBy(group).agg(ordered.alias("s")).select(group, F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("per_scan"))


def query_terms(plans: DataFrame, most: int = 12) -> DataFrame:
    """(id, ordinal, query): anchors, anchors with volumes, and both with specifics, in order and each once, `most` per plan.

    The cut is the operator's own feature: a catalogue takes only so many queries.
    """
    none = F.array(F.lit(""))
    spread = plans.select("id", F.posexplode("anchors").alias("a", "anchor"), "volumes", "specifics")
    spread = spread.select("id", "a", "anchor", F.posexplode(F.concat(none, "volumes")).alias("v", "volume"), "specifics")
    spread = spread.select("id", "a", "anchor", "v", "volume", F.posexplode(F.concat(none, "specifics")).alias("s", "specific"))
    query = F.trim(F.regexp_replace(F.concat_ws(" ", "anchor", "volume", "specific"), r"\s+", " "))
    rows = keep_first(spread.withColumn("query", query), ["id", "query"], ["a", "v", "s"])
    ordinal = F.row_number().over(Window.partitionBy("id").orderBy("a", "v", "s"))
    return rows.withColumn("ordinal", ordinal).filter(F.col("ordinal") <= most).select("id", "ordinal", "query")


def active_facets(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, bucket, terms): terms of all rules (triggers, bucket, terms) of which a trigger occurs in the claim.

    Rules meet claims by their triggers' first two characters, or the only one, where a claim has these. Rules are small beside claims: they and their
    beginnings go to every task, so a claim is read once, in its own task, and no text is moved.
    """
    pairs = F.array_union(F.regexp_extract_all("claim", F.lit("(?s)(?=(..))"), 1), F.array_union(F.split("claim", ""), F.array(F.lit(""))))
    keyed = rules.select("bucket", "terms", F.explode("triggers").alias("trigger")).withColumn("head", F.substring("trigger", 1, 2))
    known = keyed.agg(F.collect_set("head").alias("_known"))
    met = claims.select("id", "claim").crossJoin(F.broadcast(known)).select("id", "claim", F.explode(F.array_intersect(pairs, F.col("_known"))).alias("head"))
    hit = met.join(F.broadcast(keyed), "head").filter("contains(claim, trigger)").select("id", "bucket", "terms")
    return hit.groupBy("id", "bucket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))


def facet_packets(facets: DataFrame, contexts: DataFrame, most: int = 4) -> DataFrame:
    """(id, complete, covered, hits): which required facets (id, facet, terms, required) some context (id, ordinal, text) covers."""
    held = contexts.join(facets, "id").filter(F.exists("terms", lambda t: F.contains(F.col("text"), t)))
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("id", "facet").orderBy("ordinal"))).filter(F.col("r") <= most)
    hits = first.groupBy("id", "facet").agg(F.count("*").alias("hits"))
    joined = facets.select("id", "facet", "required").join(hits, ["id", "facet"], "left")
    found = F.col("hits").isNotNull()
    return joined.groupBy("id").agg(F.bool_and(found | ~F.col("required")).alias("complete"), F.count_if(found).alias("covered"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def aliased_titles(footnotes: DataFrame) -> DataFrame:
    """Footnotes (doc_id, ordinal, title, defines) with resolved_title: the first earlier definition of the title as an alias.

    A footnote that `defines` other names of its title makes them aliases for later ones; the first definition wins. An
    alias is looked up once, so this is a join with the first definitions, not a walk.
    """
    defined = footnotes.select("doc_id", F.col("ordinal").alias("at"), F.col("title").alias("target"), F.explode("defines").alias("alias")).filter("alias <> target")
    first = keep_first(defined, ["doc_id", "alias"], ["at"]).withColumnRenamed("alias", "title")
    joined = footnotes.join(first, ["doc_id", "title"], "left")
    known = F.col("target").isNotNull() & (F.col("ordinal") > F.col("at"))
    return joined.select("doc_id", "ordinal", "title", F.when(known, F.col("target")).otherwise(F.col("title")).alias("resolved_title"))


def ocr_confidence(page_confidence: Column, any_text: Column, flagged: Column) -> Column:
    value = F.coalesce(page_confidence, F.when(any_text, 0.72).otherwise(0.2))
    value = F.when(flagged, F.least(value, F.lit(0.68))).otherwise(value)
    return F.round(F.greatest(F.lit(0.1), F.least(value, F.lit(0.95))), 2)


def verification_confidence(matched_share: Column, found_share: Column, has_report: Column, flags: Column, digits: int = 2) -> Column:
    value = 0.35 + matched_share * 0.35 + found_share * 0.15 + F.when(has_report, 0.05).otherwise(0.0) - F.least(F.lit(0.35), flags * 0.06)
    return F.round(F.greatest(F.lit(0.1), F.least(value, F.lit(0.95))), digits)


def first_json(text: Column, schema: str) -> Column:
    """The first valid JSON object in a reply, read by a schema: of what begins at each opening brace, the first that parses."""
    pieces = F.split(text, r"\{")
    starts = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces)))
    tried = F.transform(starts, lambda k: F.get_json_object(F.concat(F.lit("{"), F.array_join(F.slice(pieces, k, F.size(pieces)), "{")), "$"))
    return F.from_json(F.get(F.filter(tried, lambda t: t.isNotNull()), F.lit(0)), schema)
