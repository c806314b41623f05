"""What packages of results say about themselves: confidences, styles, payloads, tables in texts, merged records and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, occurrences

#: Citation styles in the order that decides ties, and the marks that speak for each.
STYLES = {
    "chicago": (r"\".+?\.\"", r"\.\s+\d{4}[,\.]"),
    "apa": (r"\(\d{4}[a-z]?\)", r"\.\s+[A-Z][^.]+\.\s+\d+\("),
    "mla": (r"vol\.\s*\d+", r"pp\.\s*\d+"),
    "gb7714": (r"^\[\d+\]", r"\[[JMDC]\]"),
    "ieee": (r"^\[\d+\]", r"vol\.\s*\d+", r"no\.\s*\d+"),
    "harvard": (r"\(\d{4}[a-z]?\)\s+['\"]",),
}


def detected_style(citation: Column) -> Column:
    """The style with the most marks, whatever the case; the first one on ties, unknown without any."""
    text = F.coalesce(citation, F.lit(""))
    votes = {name: sum((text.rlike(f"(?i){p}").cast("int") for p in marks), F.lit(0)) for name, marks in STYLES.items()}
    best, out = F.greatest(*votes.values()), F.lit("unknown")
    for name, vote in reversed(votes.items()):
        out = F.when((vote == best) & (best > 0), name).otherwise(out)
    return out


def _kept(value: Column, low: float, high: float) -> Column:
    return F.round(F.greatest(F.lit(low), F.least(value, F.lit(high))), 2)


def _has(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names)))


def disambiguation_confidence(results: Column, average: Column, flags: Column) -> Column:
    value = average - F.when(_has(flags, "empty_context"), 0.15).otherwise(0.0) - F.when(_has(flags, "unknown_entity_rules"), 0.10).otherwise(0.0)
    return F.when(results == 0, 0.0).otherwise(_kept(value, 0.0, 1.0))


def biography_confidence(persons: Column, flags: Column) -> Column:
    return _kept(F.lit(0.45) + F.when(persons > 0, 0.35).otherwise(0.0) - F.least(F.lit(0.35), F.size(F.array_distinct(flags)) * 0.07), 0.1, 0.95)


def recognition_confidence(success: Column, pages: Column, chars: Column, flags: Column) -> Column:
    value = F.lit(0.76) + F.when(pages > 0, 0.08).otherwise(0.0) + F.when(chars > 0, 0.06).otherwise(0.0)
    return F.when(success, _kept(F.when(F.size(flags) > 0, F.least(value, F.lit(0.64))).otherwise(value), 0.1, 0.95)).otherwise(0.2)


def embedding_confidence(success: Column, initialized: Column, documents: Column, flags: Column) -> Column:
    value = F.lit(0.65) + F.when(initialized, 0.15).otherwise(0.0) + F.when(documents > 0, 0.10).otherwise(0.0)
    for weight, names in ((0.20, ("mock_embedding_used",)), (0.10, ("no_results",)), (0.20, ("empty_documents", "empty_query"))):
        value = value - F.when(_has(flags, *names), weight).otherwise(0.0)
    return F.when(success, _kept(value, 0.0, 1.0)).otherwise(0.0)


#: Marks of tone, and of rhetoric whatever their case.
SUBJECTIVE = ("I argue", "I suggest", "我认为", "笔者认为", "in my view")
OBJECTIVE = ("research shows", "evidence indicates", "研究表明", "资料显示", "the evidence suggests")
CRITICAL = ("however", "problematic", "insufficient", "然而", "不足", "值得商榷")
COMPARISON, CAUSAL, LISTING = "compared with|in contrast|whereas|相比之下|相反|与此同时", "because|therefore|thus|hence|因为|因此|由此可见", "first,|second,|finally,|首先|其次|最后"


def tone(text: Column) -> Column:
    """(perspective, stance, subjective, objective): which of the two marks is more frequent, and whether critical ones stand twice."""
    count = lambda words: sum((occurrences(text, F.lit(w)) for w in words), F.lit(0))
    subjective, objective = count(SUBJECTIVE), count(OBJECTIVE)
    perspective = F.when(objective > subjective, "objective").when(subjective > objective, "subjective").otherwise("mixed")
    return F.struct(perspective.alias("perspective"), F.when(count(CRITICAL) > 1, "critical").otherwise("measured").alias("stance"), subjective.alias("subjective"), objective.alias("objective"))


def rhetoric(text: Column) -> Column:
    """(preference, mode, comparison, causal, listing)."""
    comparison, causal, listing = (F.regexp_count(text, F.lit(f"(?i){p}")) for p in (COMPARISON, CAUSAL, LISTING))
    preference = F.when(comparison > 0, "comparison-heavy").when(listing > 0, "enumerative").otherwise("logical-argumentation")
    return F.struct(preference.alias("preference"), F.when(causal >= comparison, "deductive").otherwise("comparative").alias("mode"), comparison.alias("comparison"), causal.alias("causal"), listing.alias("listing"))


#: Decisions of a review.
DECISIONS = ("direct_support", "partial_support", "not_supported", "uncertain")


def review_payload(payload: Column, sentences: Column) -> Column:
    """(decision, best_index, exact_sentence, confidence, reason) of a reply (decision, best_index, confidence, exact_sentence, reason: strings).

    Unknown decisions are uncertain, indexes outside the sentences 0, confidences within 0 and 1. Direct support takes the sentence its index names unless its own is part of
    that, and without any sentence is uncertain; other decisions have none.
    """
    decision = F.when(F.trim(payload["decision"]).isin(*DECISIONS), F.trim(payload["decision"])).otherwise("uncertain")
    at = F.coalesce(F.when(payload["best_index"].rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(payload["best_index"]).cast("int")), F.lit(0))
    at = F.when(at.between(0, F.size(sentences)), at).otherwise(0)
    sure = F.coalesce(F.when(payload["confidence"].rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), payload["confidence"].cast("double")), F.lit(0.0))
    own = collapse(F.coalesce(payload["exact_sentence"], F.lit("")))
    named = F.get(sentences, at - 1)
    sentence = F.when((at > 0) & ((own == "") | ~F.contains(named, own)), named).otherwise(own)
    direct = (decision == "direct_support") & (sentence != "")
    return F.struct(F.when((decision == "direct_support") & ~direct, "uncertain").otherwise(decision).alias("decision"), at.alias("best_index"), F.when(direct, sentence).otherwise("").alias("exact_sentence"), F.round(F.greatest(F.lit(0.0), F.least(sure, F.lit(1.0))), 4).alias("confidence"), collapse(F.coalesce(payload["reason"], F.lit(""))).alias("reason"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", ""))
    return docs.select(key, F.posexplode(stripped).alias("_n", "_line"))


def _runs(lines: DataFrame, key: str, inside: Column, name: str) -> DataFrame:
    """Lines that are inside, with the number of their run and their place in it, both from 0."""
    order = Window.partitionBy(key).orderBy("_n")
    rows = lines.withColumn("_in", inside)
    rows = rows.withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn(name, F.sum("_new").over(order) - 1).filter("_in")
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(key, name).orderBy("_n")) - 1)


def text_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table, row, cells): neighbouring lines of two cells or more, parted by tabs or by two commas or more."""
    cells = F.transform(F.split("_line", r"\t+|,{2,}|，{2,}"), lambda c: F.regexp_replace(c, r"^[\s　]+|[\s　]+$", ""))
    lines = _lines(docs, key, text).withColumn("cells", cells)
    return _runs(lines, key, F.size("cells") > 1, "table").select(key, "table", "row", "cells")


#: How items of lists begin.
ITEMS = r"^(?:(\d+)[.、.]|([①②③④⑤⑥⑦⑧⑨⑩])|([A-Za-z])[.、.]|[-•*][\s])"


def text_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, list, row, item, kind): neighbouring lines that begin as items; a list is ordered if its first item has a number or a letter, else bullet."""
    lines = _lines(docs, key, text)
    rows = _runs(lines, key, F.col("_line").rlike(ITEMS), "list")
    marked = F.concat(*(F.regexp_extract("_line", ITEMS, k) for k in (1, 2, 3))) != ""
    first = F.first(marked).over(Window.partitionBy(key, "list").orderBy("_n"))
    item = F.regexp_replace(F.regexp_replace("_line", ITEMS, ""), r"^[\s　]+|[\s　]+$", "")
    return rows.select(key, "list", "row", item.alias("item"), F.when(first, "ordered").otherwise("bullet").alias("kind"))


FILLED = ("source_id", "url", "author", "date", "publisher", "pdf_url")


def merged_records(records: DataFrame, key: str = "query") -> DataFrame:
    """Records of each key, one for each id, else url, else title: its first one, blanks filled from later ones, routes and hints united in order.

    records: (key, list, ordinal, title, FILLED, route, hints: (snippet, pdf_page)). Records without any name stay apart.
    """
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    place = F.struct("list", "ordinal")
    name = F.coalesce(blank("source_id"), blank("url"), blank("title"), F.concat_ws("\x1f", F.lit(""), "list", "ordinal"))
    rows = records.withColumns({"_name": name, "_place": place})
    filled = [F.coalesce(F.min_by(blank(c), F.when(blank(c).isNotNull(), F.col("_place"))), F.lit("")).alias(c) for c in FILLED]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_place", c))), lambda x: x[c])
    hints = F.array_distinct(F.flatten(F.filter(ordered("hints"), lambda h: h.isNotNull())))
    routes = F.filter(F.array_distinct(ordered("route")), lambda r: F.coalesce(r, F.lit("")) != "")
    out = rows.groupBy(key, "_name").agg(F.min("_place").alias("_place"), F.min_by("title", "_place").alias("title"), *filled, routes.alias("routes"), hints.alias("hints"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_place"))
    return out.withColumn("rank", rank).drop("_name", "_place")


def ordered_sources(matches: DataFrame, key: str) -> DataFrame:
    """Matches (mismatch, priority, effective_score, source_rank) with `rank`: mismatches last, then by priority, score downwards and source rank."""
    order = Window.partitionBy(key).orderBy(F.coalesce("mismatch", F.lit(False)), "priority", F.desc("effective_score"), F.coalesce(F.nullif("source_rank", F.lit(0)), F.lit(9999)))
    return matches.withColumn("rank", F.row_number().over(order))


def record_statistics(speeches: DataFrame, dates: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """(measure, name, n) over pages: speeches, dates, entities, named speakers, the `most` frequent of these, entities by kind, first and last year.

    speeches: (speaker), dates: (year), entities: (category). Without years there are no such rows; the name orders equal speakers.
    """
    row = lambda df, measure, name, n: df.agg(n.alias("n")).select(F.lit(measure).alias("measure"), F.lit(name).alias("name"), F.col("n").cast("long").alias("n"))
    named = speeches.filter(F.coalesce("speaker", F.lit("")) != "").groupBy("speaker").agg(F.count("*").alias("n"))
    out = row(speeches, "speeches", "", F.count("*")).unionByName(row(dates, "dates", "", F.count("*"))).unionByName(row(entities, "entities", "", F.count("*"))).unionByName(row(named, "speakers", "", F.count("*")))
    best = named.orderBy(F.desc("n"), "speaker").limit(most).select(F.lit("speaker").alias("measure"), F.col("speaker").alias("name"), "n")
    kinds = entities.groupBy(F.coalesce("category", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("measure"), "name", "n")
    years = dates.filter(F.coalesce("year", F.lit(0)) != 0)
    ends = row(years, "year", "min", F.min("year")).unionByName(row(years, "year", "max", F.max("year"))).filter("n IS NOT NULL")
    return out.unionByName(best).unionByName(kinds).unionByName(ends)
