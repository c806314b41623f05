"""Pages, regions, hints and support: rules that sort what recognition and searches bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, collapse
from .dedup import keep_first
from .evidence import match_text

#: What headers look like and how page numbers stand in a line, in order.
HEADERS = "^第[一二三四五六七八九十百千]+(?:編|章|節).+|^[一二三四五六七八九十]+、.+"
PAGE_NUMBERS = (r"[　\s]*([一二三四五六七八九十百]+)[　\s]*$", r"[　\s]*(\d+)[　\s]*$", r"^[　\s]*[-－—]*\s*([一二三四五六七八九十百]+)\s*[-－—]*[　\s]*$", r"^[　\s]*[-－—]*\s*(\d+)\s*[-－—]*[　\s]*$")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def page_numeral(token: Column) -> Column:
    """1 to 99 in kanji with tens, 百 alone, or digits; null for other runs of numerals. What follows a ten and one digit is not read."""
    return bound(token, _page_numeral)


def _page_numeral(token: Column) -> Column:
    tens = r"^([一二三四五六七八九]?)十([一二三四五六七八九]?)"
    value = lambda k, blank: F.coalesce(F.nullif(F.translate(F.regexp_extract(token, tens, k), "一二三四五六七八九", "123456789"), F.lit("")).cast("int"), F.lit(blank))
    one = F.when(token.rlike("^[一二三四五六七八九]$"), F.translate(token, "一二三四五六七八九", "123456789").cast("int"))
    return F.when(token == "百", 100).when(one.isNotNull(), one).when(token.rlike(tens), value(1, 1) * 10 + value(2, 0)).when(token.rlike(r"^\d{1,9}$"), token.cast("int"))


def page_furniture(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with page_number, header, footer and body.

    The number is looked for in the last four lines, from below, pattern by pattern, then in all lines from above; its line goes. The header is the first of
    three lines that looks like one, the footer the lowest of three such below it, under 50 characters. Null texts are empty.
    """
    lines = F.split(_stripped(F.coalesce(text, F.lit(""))), "\n")
    numbered = F.transform("_lines", lambda x, k: F.struct(k.alias("k"), _stripped(x).alias("line")))
    last = F.reverse(F.slice("_numbered", F.greatest(F.size("_numbered") - 3, F.lit(1)), F.lit(4)))

    def found(x: Column, pattern: str) -> Column:
        return F.struct(page_numeral(F.regexp_extract(x["line"], pattern, 1)).alias("n"), x["k"].alias("k"))

    def told(candidates: Column) -> Column:
        return F.get(F.filter(candidates, lambda c: c["n"].isNotNull()), F.lit(0))

    # Each pattern, and then all lines, are tried only where those before them found nothing.
    below = [told(_each(last, found, pattern)) for pattern in PAGE_NUMBERS]
    above = told(F.flatten(F.transform("_numbered", lambda x: F.array(*[found(x, p) for p in PAGE_NUMBERS]))))
    first = F.coalesce(*below, above)
    rows = pages.withColumn("_lines", lines).withColumn("_numbered", numbered).withColumn("_n", first)
    rest = F.filter("_lines", lambda x, k: F.col("_n").isNull() | (k != F.col("_n.k")))
    # What is left is read anew: it is a text of its own.
    rows = rows.withColumn("_rest", F.split(_stripped(F.array_join(rest, "\n")), "\n")).withColumn("_at", F.transform("_rest", lambda x, k: F.struct(k.alias("k"), _stripped(x).alias("line"))))
    head = F.get(F.filter(F.slice("_at", 1, 3), lambda x: x["line"].rlike(HEADERS)), F.lit(0))
    rows = rows.withColumn("_head", head)
    begin = F.coalesce(F.col("_head.k") + 1, F.lit(0))
    low = F.greatest(begin, F.size("_at") - 4)
    foot = F.try_element_at(F.filter("_at", lambda x: (x["k"] > low) & (x["line"] != "") & (F.length(x["line"]) < 50) & x["line"].rlike(HEADERS)), F.lit(-1))
    rows = rows.withColumn("_foot", foot)
    stop = F.coalesce(F.col("_foot.k"), F.size("_at"))
    body = F.array_join(F.filter("_rest", lambda x, k: (k >= begin) & (k < stop)), "\n")
    return rows.select(*pages.columns, F.col("_n.n").alias("page_number"), F.coalesce("_head.line", F.lit("")).alias("header"), F.coalesce("_foot.line", F.lit("")).alias("footer"), body.alias("body"))


def _each(items: Column, found, pattern: str) -> Column:
    return F.transform(items, lambda x: found(x, pattern))


_N = "[一二三四五六七八九十]+"
#: Dates of a region, words of a title, dates and weather of a content.
REGION_DATES = rf"(?:明治|大正|昭和|平成){_N}年{_N}月{_N}日|\d{{4}}年\d{{1,2}}月\d{{1,2}}日|{_N}月{_N}日"
CONTENT_DATES = rf"(?:明治|大正|昭和){_N}年|{_N}月{_N}日"


def region_class(text: Column, top: Column, bottom: Column, page_height: Column) -> Column:
    """header, footer, date, title, body_text; unknown without text."""
    size = F.length(text)
    blank = F.coalesce(size, F.lit(0)) == 0
    return F.when(blank, "unknown").when((top < page_height * 0.1) & (size < 50), "header").when((bottom > page_height * 0.9) & (size < 50), "footer").when(text.rlike(REGION_DATES), "date").when(text.rlike("目次|目録|序|跋|章|編|巻") & (size < 30), "title").otherwise("body_text")


def content_class(text: Column) -> Column:
    """date, weather, quote, handwritten; unknown without text."""
    size = F.length(text)
    blank = F.coalesce(size, F.lit(0)) == 0
    return F.when(blank, "unknown").when(text.rlike(CONTENT_DATES), "date").when(text.rlike("[晴曇雨雪風]") & (size < 10), "weather").when(text.rlike("[「」『』]"), "quote").otherwise("handwritten")


#: Kinds of sources and the words that hint at them, in order.
SOURCE_HINTS = {
    "archive": "National Archives|UK National Archives|State Papers|TNA|公共図書館|国立公文書館|国会図書館|Archives?|Archival",
    "manuscript": "Manuscript|手稿|写本|文献|Unpublished|source",
    "chronicle": "Chronicle|年代記|编年史|Annals|紀年",
    "parliament": "Parliamentary Records?|国会記録|議会記録|Hansard|Journals",
    "registry": "Record Office|登記所|档案馆|Parish Register",
    "correspondence": "Letters|書簡|書状|Correspondence|Diplomatic",
    "legal": "Legal|法令|Law|Capitularies|Statutes",
    "statistical": "Statistical|Census|人口調査|税帳簿|Tax Roll",
}


def source_hints(works: DataFrame, key: str, order: str, most: int = 15) -> DataFrame:
    """(key, hints): kinds of sources that title or abstract of the first `most` works of a key hint at, in order of appearance."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    kinds = F.array_compact(F.array(*[F.when(text.rlike(f"(?iu)(?:{p})"), name) for name, p in SOURCE_HINTS.items()]))
    rows = works.select(key, place.alias("_place"), kinds.alias("_kinds")).filter(F.col("_place") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_kinds"))), lambda x: x["_kinds"])
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(ordered)).alias("hints"))


#: Ranks of leads.
LEADS = ("body_candidate", "short_or_unexpanded", "title_or_series_only", "toc_or_index", "wrong_pid")


def ordered_leads(hints: DataFrame, key: str, preferred: str | None = None) -> DataFrame:
    """Hints (category, has_claim, is_specific, specificity, has_context, has_page, source_id, ordinal) with `rank` by these in this order, then as they came.

    With `preferred`, the name of a column with a source id, hints of other sources go; those of none stay. Other categories come last.
    """
    rows = hints
    if preferred:
        wanted, own = (F.coalesce(c, F.lit("")) for c in (preferred, "source_id"))
        rows = rows.filter((wanted == "") | (own == "") | (own == wanted))
    lead = F.coalesce(*[F.when(F.col("category") == name, k) for k, name in enumerate(LEADS)], F.lit(len(LEADS)))
    no = lambda c: (~F.coalesce(c, F.lit(False))).cast("int")
    order = Window.partitionBy(key).orderBy(lead, no("has_claim"), no("is_specific"), F.desc("specificity"), no("has_context"), no("has_page"), "ordinal")
    return rows.withColumn("rank", F.row_number().over(order))


#: Buckets that make facets, in order, and whether one is required.
FACETS = (("document_heading", True), ("policy", True), ("theme", True), ("page_near", True), ("contained", True), ("special_term", True), ("person", False), ("date", False), ("document_title", False))


def generic_facets(buckets: DataFrame, most: int = 8, least: int = 2) -> DataFrame:
    """(id, facet_id, place, required, terms) from buckets (id, bucket, ordinal, term), where two facets at least are required.

    Terms of three characters or more in their match form count, each once, `most` a bucket. If fewer than two facets are required of
    themselves, persons and dates with a month or a day become so, in order, until two are.
    """
    term = F.trim("term")
    rows = buckets.select("id", "bucket", "ordinal", term.alias("term")).withColumn("_m", match_text(F.col("term"))).filter(F.length("_m") >= 3)
    once = keep_first(rows, ["id", "bucket", "term"], ["ordinal"])
    place = F.coalesce(*[F.when(F.col("bucket") == name, k) for k, (name, _) in enumerate(FACETS)])
    ranked = once.withColumns({"place": place, "_r": F.row_number().over(Window.partitionBy("id", "bucket").orderBy("ordinal", "term"))}).filter((F.col("_r") <= most) & F.col("place").isNotNull())
    terms = F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"])
    facets = ranked.groupBy("id", "bucket", "place").agg(terms.alias("terms"))
    facets = facets.withColumn("_own", F.col("bucket").isin([name for name, required in FACETS if required]))
    may = (F.col("bucket") == "person") | ((F.col("bucket") == "date") & F.exists("terms", lambda t: t.rlike("[月日]")))
    whole, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("place")
    facets = facets.withColumns({"_need": F.greatest(F.lit(0), least - F.sum(F.col("_own").cast("int")).over(whole)), "_may": (~F.col("_own") & may).cast("int")})
    facets = facets.withColumn("required", F.col("_own") | ((F.col("_may") == 1) & (F.sum("_may").over(order) <= F.col("_need"))))
    kept = facets.withColumn("_n", F.sum(F.col("required").cast("int")).over(whole)).filter(F.col("_n") >= least)
    return kept.select("id", F.concat(F.lit("bucket_"), "bucket").alias("facet_id"), "place", "required", "terms")


def merged_snippets(records: DataFrame, known: DataFrame, contents: DataFrame, page_maps: DataFrame) -> DataFrame:
    """(pid, ordinal, snippet, pdf_page, cid): hints that a reply adds to the records (pid), in its order.

    contents: (pid, ordinal, cid, index, matches: (head, word, tail)); page_maps: (pid, cid, page), else the page after `index`. Blank snippets, and those that
    the record knows (pid, snippet, pdf_page) or that came before with the same page, add nothing.
    """
    rows = contents.join(records.select("pid").distinct(), "pid", "left_semi").join(page_maps.select("pid", "cid", F.col("page").alias("_page")), ["pid", "cid"], "left")
    page = F.coalesce("_page", F.col("index") + 1)
    each = rows.select("pid", "ordinal", F.coalesce("cid", F.lit("")).alias("cid"), page.alias("pdf_page"), F.posexplode("matches").alias("_k", "_m"))
    parts = [F.coalesce(F.col(f"_m.{c}"), F.lit("")) for c in ("head", "word", "tail")]
    hints = each.withColumn("snippet", collapse(F.concat(*parts))).filter("snippet <> ''")
    first = keep_first(hints, ["pid", "snippet", "pdf_page"], ["ordinal", "_k"])
    seen = known.select(F.col("pid").alias("_p"), F.col("snippet").alias("_s"), F.col("pdf_page").alias("_g"))
    fresh = first.join(seen, (F.col("pid") == F.col("_p")) & (F.col("snippet") == F.col("_s")) & F.col("pdf_page").eqNullSafe(F.col("_g")), "left_anti")
    ordinal = F.row_number().over(Window.partitionBy("pid").orderBy("ordinal", "_k")) - 1
    return fresh.select("pid", ordinal.alias("ordinal"), "snippet", "pdf_page", "cid")


#: Notes of an alignment that cannot vouch by itself, and the limits of confidence.
WEAK_NOTES = ("heuristic_alignment_used", "llm_alignment_failed:", "context_alignment_preview_higher_confidence:", "context_alignment_selected_over_weak_cited_page:", "cited_pages_no_alignment_context_fallback", "cited_pages_not_extracted_context_fallback")
LEAST_CONFIDENCE, DIRECT_CONFIDENCE = 0.12, 0.60


def support_assessment(decision: Column, exact: Column, reason: Column, matched: Column, confidence: Column, distance: Column, scope: Column, notes: Column) -> Column:
    """(support, verification): whether a passage supports its citation, by the review's decision, else by confidence, page distance, scope and notes."""
    given = lambda c: F.coalesce(collapse(c), F.lit("")) != ""
    said, sure = F.lower(F.coalesce(notes, F.lit(""))), F.coalesce(confidence, F.lit(0.0))
    far = F.coalesce(distance > 1, F.lit(False))
    has = lambda mark: F.contains(said, F.lit(mark))
    weak = F.coalesce(scope, F.lit("")) != "cited_pages"
    for mark in WEAK_NOTES:
        weak = weak | has(mark)
    direct = F.coalesce(decision == "direct_support", F.lit(False)) & given(exact)
    status = (
        F.when(direct & far, "page_mismatch_but_support")
        .when(direct, "direct_support")
        .when(decision.isin("not_supported", "partial_support"), decision)
        .when((decision == "uncertain") & given(reason), "needs_manual_review")
        .when(~given(matched), F.when(has("llm_rejected"), "not_supported").otherwise("needs_manual_review"))
        .when(sure < LEAST_CONFIDENCE, "needs_manual_review")
        .when(far & (sure >= DIRECT_CONFIDENCE) & ~has("llm_alignment_failed"), "page_mismatch_but_support")
        .when(far | weak, "partial_support")
        .when(sure >= DIRECT_CONFIDENCE, "direct_support")
        .otherwise("partial_support")
    )
    return F.struct(status.alias("support"), F.when(status.isin("direct_support", "page_mismatch_but_support"), "matched").otherwise("needs_manual_review").alias("verification"))
