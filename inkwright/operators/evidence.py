"""Evidence alignment: claims against passages, nearest and range joins, review decisions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.cleanup import MATCH_MARKS, MATCH_VARIANTS
from ..functions.text import collapse
from .dedup import keep_first
from .spread import spread

HAN = "[㐀-鿿]"


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two short texts; there is no built-in for it."""
    return pd.Series([_ratio(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


def _ratio(a: str, b: str) -> float:
    # Under 200 characters none are left out as too frequent, so the part that both share is the longest block and nothing lies beside it.
    if len(b) < 200 and (a in b or b in a) and a and b:
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return 0.0 if a and b and set(a).isdisjoint(b) else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def match_text(text: Column) -> Column:
    """Compatibility forms, no parentheticals, one form of variant characters, no quotes, brackets, full stops of East Asian texts or space, lower case.

    Commas, full stops and other marks of Western texts stay, for they may tell numbers apart.
    """
    plain = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "[（(][^）)]*[）)]", "")
    return F.lower(F.translate(plain, MATCH_VARIANTS[0] + MATCH_MARKS, MATCH_VARIANTS[1]))


def text_similarity(left: Column, right: Column) -> Column:
    """1 if one holds the other, else the ratio rounded to 4 places; null if either is empty."""
    a, b = match_text(left), match_text(right)
    return F.when((a == "") | (b == ""), None).when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(F.bround(sequence_ratio(a, b), 4))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def _is_han(letter: Column) -> Column:
    return letter.between(HAN[1], HAN[3])


def _characters(text: Column) -> Column:
    """Distinct Han characters."""
    return F.when(text.rlike(HAN), F.array_distinct(F.filter(F.split(text, ""), _is_han))).otherwise(F.array().cast("array<string>"))


def _pairs(text: Column) -> Column:
    """Distinct pairs of neighbours, one of them at least a Han character."""
    letters = F.split(text, "")
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters)), lambda x, y: F.when(_is_han(x) | _is_han(y), F.concat(x, y)))
    return F.when((F.length(text) >= 2) & text.rlike(HAN), F.array_distinct(F.array_compact(pairs))).otherwise(F.array().cast("array<string>"))


def han_overlap(claim: Column, segment: Column) -> Column:
    return _overlap(_characters(claim), _characters(segment))


def bigram_overlap(claim: Column, segment: Column) -> Column:
    return _overlap(_pairs(claim), _pairs(segment))


def cue_score(claim: Column, segment: Column, groups: dict[str, list[str]]) -> Column:
    """Of the cue groups that the claim has, the share that the segment has too."""
    active, both = F.lit(0), F.lit(0)
    for words in groups.values():
        has = lambda t, words=words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
        active = active + has(claim).cast("int")
        both = both + (has(claim) & has(segment)).cast("int")
    return F.when(active > 0, both / active).otherwise(0.0)


def _sides(rows: DataFrame, text: str, side: str) -> DataFrame:
    """Rows with what a score takes from a text: its match_text, Han characters and pairs, as _<side>, _<side>h and _<side>p."""
    return rows.withColumn(f"_{side}", match_text(F.col(text))).withColumns({f"_{side}h": _characters(F.coalesce(text, F.lit(""))), f"_{side}p": _pairs(F.col(f"_{side}"))})


_SIDES = ("_a", "_ah", "_ap", "_b", "_bh", "_bp")


def _scored(rows: DataFrame, claim: str, text: str, groups: dict[str, list[str]], classes: list[str]) -> DataFrame:
    """Rows with _sides of a claim (a) and a text (b): those that can be the best of their classes, and their exact score.

    A score is known but for its share of 0.20 for the ratio, which is at most 1 and at most what the two lengths allow. Ratios are computed only where
    that share can make up for what is missing to the highest sum without it.
    """
    empty = (F.col("_a") == "") | (F.col("_b") == "")
    la, lb = F.least(F.length("_a"), F.lit(400)), F.least(F.length("_b"), F.lit(400))
    cues = cue_score(F.col(claim), F.col(text), groups)
    parts = {"_h": _overlap(F.col("_ah"), F.col("_bh")) * 0.35, "_p": _overlap(F.col("_ap"), F.col("_bp")) * 0.25, "_c": cues * 0.20, "_more": F.when(empty, 0.0).otherwise(F.least(la, lb) * 0.40 / (la + lb))}
    rows = rows.withColumns(parts).drop("_ah", "_bh", "_ap", "_bp").withColumn("_known", F.when(empty, 0.0).otherwise(F.col("_h") + F.col("_p") + F.col("_c")))
    rows = rows.withColumn("_least", F.max("_known").over(Window.partitionBy(*classes))).filter("_known + _more + 1e-9 >= _least")
    ratio = sequence_ratio(F.substring("_a", 1, 400), F.substring("_b", 1, 400))
    score = F.when(empty, 0.0).otherwise(F.least(ratio * 0.20 + F.col("_h") + F.col("_p") + F.col("_c"), F.lit(1.0)))
    return rows.withColumn("score", score).drop("_a", "_b", "_h", "_p", "_c", "_known", "_more", "_least")


def review_decision(score: Column, cues: Column, cue_matches: Column) -> Column:
    return F.when(score >= 0.45, "direct_support").when((score >= 0.16) | ((cues >= 0.25) & (cue_matches >= 2)), "partial_support").otherwise("not_supported")


def page_segments(passages: DataFrame, least: int = 20, outer: bool = False) -> DataFrame:
    """passages (text) with place and segment: blocks between blank lines that have `least` characters when cleaned.

    A text that is not blank always has such blocks, so sentences are never grouped instead. `outer` keeps passages without any, with null.
    """
    blocks = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "\r", "\n"), r"\n{2,}"), lambda p: F.btrim(p, F.lit(" \t\n\v\f\r　")))
    whole = F.filter(blocks, lambda p: F.length(p) > 0)
    numbered = F.filter(F.transform(whole, lambda p, k: F.struct(k.alias("place"), p.alias("segment"))), lambda x: F.length(collapse(x["segment"])) >= least)
    kept = [c for c in passages.columns if c != "text"]
    return passages.select(*kept, (F.explode_outer if outer else F.explode)(numbered).alias("_s")).select(*kept, "_s.place", "_s.segment")


def trimmed_segments(rows: DataFrame, key: list[str], groups: dict[str, list[str]], size: int = 220, step: int = 60, whole: int = 260) -> DataFrame:
    """Rows (key, claim, segment) with `matched`: the segment up to a scan number; of one longer than `whole` its best window, if that scores more than all of it."""
    kept = rows.columns
    cleaned = collapse(F.split("segment", r"E\d{6,}", 2)[0])
    starts = F.when(F.length("_t") > whole, F.sequence(F.lit(0), F.greatest(F.length("_t") - size, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = rows.withColumn("_t", cleaned).withColumn("_at", F.explode(F.concat(F.array(F.lit(-1)), starts)))
    parts = parts.withColumn("_w", F.when(F.col("_at") < 0, F.col("_t")).otherwise(F.substring(F.col("_t"), F.col("_at") + 1, F.lit(size))))
    # Nothing is compared where there is one part only.
    single = F.length("_t") <= whole
    parts = parts.withColumns({"_x": F.when(single, "").otherwise(F.col("claim")), "_y": F.when(single, "").otherwise(F.col("_w"))})
    scored = _scored(_sides(_sides(parts, "_x", "a"), "_y", "b"), "claim", "_y", groups, key)
    first = [c for c in kept if c not in key]
    best = scored.groupBy(*key).agg(*(F.first(c).alias(c) for c in first), F.max_by("_w", F.struct("score", -F.col("_at"))).alias("matched"))
    return best.select(*kept, "matched")


def aligned(claims: DataFrame, passages: DataFrame, groups: dict[str, list[str]], least: int = 20) -> DataFrame:
    """The best passage of each claim: (candidate_id, claim, page, segment, score, matched), joined on candidate_id.

    Passages are split at blank lines; segments under `least` characters don't count. The exact score decides, ties go to the lower page; it is told
    to four places, and `matched` is the part of a long segment that fits best.
    """
    segments = _sides(page_segments(spread(passages.select("candidate_id", "page", "text"), "candidate_id"), least), "segment", "b")
    # Sizes of exploded texts are not foreseen, so a side that is taken for small could be too much for the driver to send.
    pairs = _sides(spread(claims, "candidate_id"), "claim", "a").join(segments.hint("merge"), "candidate_id")
    scored = _scored(pairs, "claim", "segment", groups, ["candidate_id", "claim"])
    best = keep_first(scored, ["candidate_id", "claim"], [F.desc("score"), "page", "place"]).drop("place")
    return _rounded(trimmed_segments(best.withColumnRenamed("score", "_score").withColumn("_k", F.md5("claim")), ["candidate_id", "_k"], groups).drop("_k").withColumnRenamed("_score", "score"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.bround("score", 4))


def page_priority_alignment(candidates: DataFrame, pages: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(candidate_id, page, matched, score, scope, notes) of candidates by the pages they cite, then by those around them.

    candidates: (candidate_id, claim, cited: pages, mode: page span, claims: parts of the claim); pages: (candidate_id, ordinal, page, text).

    * Without cited pages all pages count. If no cited page is there, all pages do (context_fallback).
    * Spans of separate pages are aligned claim by claim, eight at most, to the cited pages; `matched` lists what was found.
    * In a continuous range the cited pages also count as one page, the first.
    * A context page is taken instead where `context_promotion` says so.
    * If the cited pages give nothing, all pages count again.

    Every segment meets the whole claim once and, on cited pages of a separate span, the claim's parts; the scopes are the best of these rows.
    """
    here = Window.partitionBy("candidate_id")
    held = spread(pages.select("candidate_id", "ordinal", "page", "text"), "candidate_id").join(candidates.select("candidate_id", "cited", "mode"), "candidate_id")
    held = held.withColumn("is_cited", F.coalesce(F.array_contains("cited", F.col("page")), F.lit(False))).drop("cited")
    shown = F.when(F.col("is_cited") & (F.col("mode") == "continuous_range"), F.struct("page", "ordinal", F.coalesce("text", F.lit("")).alias("t")))
    held = held.withColumns({"n_cited": F.sum(F.col("is_cited").cast("long")).over(here), "_n": F.row_number().over(here.orderBy(F.desc("is_cited"), "page", "ordinal")), "_p": F.collect_list(shown).over(here)})
    several = (F.col("_n") == 1) & (F.size(F.array_distinct(F.transform("_p", lambda x: x["page"]))) >= 2)
    joined = F.array_join(F.transform(F.filter(F.array_sort("_p"), lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n")
    # The continuous range as one page goes with the first of its pages.
    texts = F.array(F.struct("ordinal", "text", F.lit(False).alias("joined")), F.when(several, F.struct(F.lit(1 << 30).cast(pages.schema["ordinal"].dataType).alias("ordinal"), joined.alias("text"), F.lit(True).alias("joined"))))
    rows = held.withColumn("_p", F.explode(F.filter(texts, lambda x: x.isNotNull()))).select("candidate_id", "_p.*", "page", "mode", "is_cited", "n_cited")
    apart = F.col("is_cited") & ~F.col("joined") & (F.col("mode") == "distributed_pages") & (F.col("n_cited") >= 2)
    segments = _sides(page_segments(rows, outer=True).withColumn("_apart", F.coalesce(apart & F.col("segment").isNotNull(), F.lit(False))), "segment", "b")

    listed = F.slice(F.coalesce("claims", F.array("claim")), 1, 8)
    whole = F.array(F.struct(F.lit(-1).alias("index"), F.col("claim").alias("part")))
    numbered = F.transform(F.when(F.size(listed) > 0, listed).otherwise(F.array("claim")), lambda c, k: F.struct(k.alias("index"), c.alias("part")))
    parts = candidates.select("candidate_id", F.inline(F.concat(whole, F.when(F.col("mode") == "distributed_pages", numbered).otherwise(F.array().cast("array<struct<index:int,part:string>>")))))
    met = _sides(spread(parts, "candidate_id"), "part", "a").join(segments, "candidate_id").filter("index < 0 OR _apart")
    scored = _scored(met, "part", "segment", groups, ["candidate_id", "index", "is_cited", "joined"])
    best = lambda when: F.max_by(F.when(when, F.struct("page", "segment", "score")), F.when(when & F.col("segment").isNotNull(), F.struct("score", -F.col("ordinal"), -F.col("place"))))
    scopes = scored.groupBy("candidate_id", "index").agg(F.first("part").alias("part"), F.first("n_cited").alias("n_cited"), F.first("mode").alias("_mode"), best(F.col("is_cited")).alias("_cited"), best(~F.col("is_cited")).alias("_context"), best(~F.col("joined")).alias("_all"))

    out = candidates.select("candidate_id", "claim", "cited").join(scopes, "candidate_id", "left").withColumns({"n_cited": F.nullif("n_cited", F.lit(0)), "index": F.coalesce("index", F.lit(-1))})
    out = out.withColumn("_spread", F.max("index").over(here) >= 0)
    score = lambda c: F.coalesce(F.bround(F.col(f"{c}.score"), 4), F.lit(0.0))
    none = F.coalesce(F.size("cited"), F.lit(0)) <= 0
    distance = page_distance(F.col("_context.page"), F.col("cited"))
    better = F.coalesce(F.col("_context").isNotNull() & (score("_context") > score("_cited") + 0.15), F.lit(False))
    promoted = F.coalesce(F.col("_context").isNotNull() & context_promotion(F.when(F.col("_cited").isNull(), 0.0).otherwise(score("_cited")), score("_context"), distance), F.lit(False))
    scope = F.when(none, "all_extracted_pages").when(F.col("n_cited").isNull(), "context_fallback").when(F.col("_spread"), "distributed_cited_pages").when(promoted, "context_promoted_from_cited_pages").when(F.col("_cited").isNotNull(), "cited_pages").otherwise("context_fallback")
    out = out.withColumn("scope", scope)
    chosen = F.when(F.col("scope") == "context_promoted_from_cited_pages", F.col("_context")).when(F.col("scope") == "cited_pages", F.col("_cited")).otherwise(F.col("_all"))
    used = ~none & F.col("n_cited").isNotNull() & ~F.col("_spread")
    place = F.concat(F.lit("p"), F.col("_context.page").cast("string"))
    aligned_here = F.when(chosen.isNull(), "no_passage_candidates").otherwise("heuristic_alignment_used")
    notes = F.concat_ws(
        "; ",
        F.when(F.col("scope") == "distributed_cited_pages", "distributed_page_claim_alignment_used"),
        F.when(used, "cited_page_alignment_used"),
        F.when(used & (F.col("_mode") == "continuous_range"), "continuous_page_window_alignment_used"),
        F.when(used, F.when(F.col("_cited").isNull(), "no_passage_candidates").otherwise("heuristic_alignment_used")),
        F.when(used & better, F.concat(F.lit("context_alignment_preview_higher_confidence:"), place)),
        F.when(used & promoted, F.concat(F.lit("context_alignment_selected_over_weak_cited_page:"), place)),
        F.when(used & (F.col("scope") == "context_fallback"), F.concat(F.lit("cited_pages_no_alignment_context_fallback; "), aligned_here)),
        F.when(~none & F.col("n_cited").isNull(), F.concat(F.lit("cited_pages_not_extracted_context_fallback; "), aligned_here)),
        F.when(none, aligned_here),
    )
    is_part = F.col("index") >= 0
    picked = out.withColumns({"notes": notes, "_chosen": F.when(is_part, F.col("_all")).when(F.col("scope") != "distributed_cited_pages", chosen)})
    picked = picked.select("candidate_id", "index", F.when(is_part, F.col("part")).otherwise(F.col("claim")).alias("claim"), F.col("_chosen.page").alias("page"), F.col("_chosen.segment").alias("segment"), F.bround("_chosen.score", 4).alias("score_"), "scope", "notes")
    trimmed = trimmed_segments(picked, ["candidate_id", "index"], groups)
    # One row a candidate: that of its whole claim, or what its parts found, in their order.
    found = F.array_sort(F.collect_list(F.when(is_part, F.struct("index", F.concat(F.lit("[p"), F.col("page").cast("string"), F.lit("] "), "matched").alias("t")))))
    only = lambda c: F.max(F.when(~is_part, F.col(c)))
    first = F.max_by(F.when(is_part, F.col("page")), F.when(is_part, F.struct("score_", -F.col("index"))))
    by_parts = F.max("index") >= 0
    text = F.when(by_parts, F.array_join(F.transform(found, lambda x: x["t"]), "\n\n")).otherwise(F.coalesce(only("matched"), F.lit("")))
    return trimmed.groupBy("candidate_id").agg(F.when(by_parts, first).otherwise(only("page")).alias("page"), text.alias("matched"), F.max("score_").alias("score"), F.first("scope").alias("scope"), only("notes").alias("notes"))


def narrowest_range(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Each request (id, start, stop) with the narrowest cached range (id, c_start, c_stop, ordinal) that holds it.

    A cached range lies in the bin of its start among bins of the least power of two that is as long as it. One that holds a request starts in the
    request's bin or the one before, for each such length; so requests meet ranges around them, not all of their id.
    """
    size = lambda low, high: F.ceil(F.log2(F.greatest(high - low + 1, F.lit(1)).cast("double"))).cast("int")
    width = lambda k: F.pow(F.lit(2.0), k)
    held = cached.filter("c_stop >= c_start").withColumn("_size", size(F.col("c_start"), F.col("c_stop")))
    held = held.withColumn("_bin", F.floor(F.col("c_start") / width(F.col("_size"))))
    sizes = [r["_size"] for r in held.select("_size").distinct().collect()]  # at most one for each bit of a length
    asked = requests.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).filter(F.col("_size") >= size(F.col("start"), F.col("stop")))
    at = F.floor(F.col("start") / width(F.col("_size")))
    asked = asked.withColumn("_bin", F.explode(F.array(at, at - 1)))
    met = asked.join(held, ["id", "_size", "_bin"]).filter("c_start <= start AND c_stop >= stop").drop("_size", "_bin")
    return keep_first(met, ["id", "start", "stop"], [F.col("c_stop") - F.col("c_start"), "ordinal"])


def preferred_hit(hits: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """The first hit (page, ordinal) in the window (low, high) of its key, else the one nearest to its middle.

    Without a window the first hit stays; hits without a page come last.
    """
    middle = (F.col("low") + F.col("high")) / 2
    inside = F.col("page").between(F.col("low"), F.col("high"))
    rows = hits.join(windows, key, "left").withColumn("in_window", F.coalesce(inside, F.lit(False)))
    distance = F.when(F.col("in_window") | F.col("low").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col("page") - middle), F.lit(9999.0)))
    return keep_first(rows.withColumn("distance", distance), [key], [F.desc("in_window"), "distance", "ordinal"])


def previous_definition(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the last earlier row of its group that has a value: a backward as-of join by window, not by pairs."""
    earlier = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col(value).isNotNull(), F.col(order)), ignorenulls=True).over(earlier)
    return rows.withColumns({"defined_at": at, "defined_value": F.last(value, ignorenulls=True).over(earlier)})


def page_distance(page: Column, cited: Column) -> Column:
    return F.array_min(F.transform(cited, lambda p: F.abs(p - page)))


def page_check(page: Column, low: Column, high: Column) -> Column:
    return F.when(page.isNull(), "no_pdf_page").when(low.isNull(), "fulltext_pdf_page_only").when(page.between(low, high), "fulltext_page_inside_downloaded_window").otherwise("fulltext_page_outside_downloaded_window")


def context_promotion(cited_score: Column, context_score: Column, distance: Column) -> Column:
    """A context page replaces the cited one if it is better by more than 0.15, at least 0.30, one page away at most, and the cited one is below 0.20."""
    return (context_score - cited_score > 0.15) & (context_score >= 0.30) & (distance <= 1) & (cited_score < 0.20)


def matched_dates(annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """Source dates (page, date_key) with the first annotation (page, date_key, text) of that date, by page."""
    first = annotations.groupBy("date_key").agg(F.min_by(F.struct(F.col("page").alias("annotation_page"), F.col("text").alias("annotation_text")), F.struct("page", "text")).alias("_a"))
    return sources.join(first, "date_key").select("page", "date_key", "_a.*")


def publication_year(dates: DataFrame, key: str) -> DataFrame:
    """(key, year, era): the latest year among the dates (key, year) of a work, and the first era that holds it."""
    from ..functions.dates import era_of_year

    latest = dates.filter("year IS NOT NULL").groupBy(key).agg(F.max("year").alias("year"))
    return latest.withColumn("era", era_of_year(F.col("year")))


#: How much a decision counts.
DECISIONS = {"direct_support": 3, "partial_support": 2, "uncertain": 1, "not_supported": 0}


def reviewed_contexts(contexts: DataFrame, key: str) -> DataFrame:
    """The best context of each key with its decision and confidence.

    `contexts`: key, ordinal, context_id, decision, confidence, score, body (a body text), core (it holds core terms). A body text with
    core terms and a score of 10 counts as direct support, one with 7 that was rejected as partial support. Decision,
    confidence and score decide in this order; the first context wins ties.
    """
    score = F.col("score")
    direct = F.col("body") & F.col("core") & (score >= 10)
    partial = F.col("body") & (score >= 7) & (F.col("decision") == "not_supported")
    decision = F.when(direct, "direct_support").when(partial, "partial_support").otherwise(F.col("decision"))
    sure = F.when(direct, F.round(F.least(F.lit(0.92), F.greatest(F.lit(0.72), score / 18)), 4)).when(partial, F.round(F.least(F.lit(0.78), F.greatest(F.lit(0.45), score / 18)), 4)).otherwise(F.col("confidence"))
    rank = F.coalesce(*[F.when(F.col("decision") == d, n) for d, n in DECISIONS.items()], F.lit(0))
    rows = contexts.withColumns({"decision": decision, "confidence": sure}).withColumn("combined", rank * 100.0 + F.col("confidence") * 10.0 + score)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("combined"), "ordinal"))
    return rows.withColumn("_r", best).filter("_r = 1").select(key, "context_id", "decision", "confidence", "combined")
