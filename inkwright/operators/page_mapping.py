"""Which scan shows a book page: anchors from tables of contents and from printed numbers, caches, and the range to fetch.

`pages` has (book, scan, text). A mapping has (anchor_scan, anchor_book, pages_per_scan, method, confidence). Null texts are empty; a book without an
anchor has no mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import scan_page
from ..functions.text import bound
from .evidence import nfkc
from .spread import spread

#: What marks a page of contents, headings in the body, the words a heading may be known by, lengths of its beginnings.
CONTENTS = ("目次", "目録", "Contents", "CONTENTS")
HEADINGS = (r"第[一二三四五六七八九十百0-9０-９]+[章節部編篇][^\n]{0,40}", r"(?:序|序章|序論|緒言|緒論|凡例|はしがき|まえがき|第一)[^\n]{0,30}")
OPENINGS = ("序", "緒言", "緒論", "凡例", "はしがき", "まえがき")
BEGINNINGS = (24, 18, 14, 10, 8, 6, 4)
_EDGES = " 　\t\r\n、。・.,"
_DIGITS, _UNITS = "〇○零一二三四五六七八九", "十百千"
#: Reasons after which a book is not tried again.
HARD_FAILURES = ("remote_copy_only_no_print", "ndl_toc_not_found", "ndl_toc_empty", "front_matter_mapping_not_inferred", "download_not_pdf", "download_http_404", "download_http_403", "print_button_not_found", "download_link_not_found")
MAPPING = ("anchor_scan", "anchor_book", "pages_per_scan", "method", "confidence")


def printed_number(token: Column) -> Column:
    """Digits or kanji digits by place, else kanji digits with units; null for 0 and anything else."""
    plain = F.translate(token, "Oo" + _DIGITS, "00" + "000123456789")
    by_place = F.when(F.length(plain) <= 9, plain.cast("int"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"))

    def step(s: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        counted = F.when(s["held"] == 0, 1).otherwise(s["held"])
        return F.when(unit.isNull(), F.struct(s["total"].alias("total"), c.cast("int").alias("held"))).otherwise(F.struct((s["total"] + counted * unit).alias("total"), F.lit(0).alias("held")))

    with_units = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), start, step, lambda s: s["total"] + s["held"])
    value = F.when(plain.rlike("^[0-9]+$"), by_place).when(plain.rlike(f"^[0-9{_UNITS}]{{1,12}}$"), with_units)
    return F.nullif(value, F.lit(0))


def _form(text: Column) -> Column:
    """Letters, digits and kana alone."""
    return F.regexp_replace(text, r"(?U)[^\w一-龥ぁ-んァ-ヶ]+", "")


def _is_contents(text: Column) -> Column:
    out = F.lit(False)
    for mark in CONTENTS:
        out = out | F.contains(text, F.lit(mark))
    return out


def _listed_page(contents: Column, heading: Column) -> Column:
    """Page number that follows the heading, or the longest known beginning of it, in the form of a page of contents."""
    return bound(_form(heading), lambda name: _page_after(contents, name))


def _page_after(contents: Column, name: Column) -> Column:
    begun = [F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in BEGINNINGS]
    opened = [F.when(F.startswith(name, F.lit(o)), F.lit(o)) for o in OPENINGS]
    tried = F.array_distinct(F.filter(F.array(name, *begun, *opened), lambda x: F.length(x) >= 2))

    def page(x: Column) -> Column:
        after = lambda at: F.substring(contents, at + F.length(x), F.lit(80))
        number = lambda at: bound(F.regexp_extract(after(at), rf"([0-9{_DIGITS}{_UNITS}]{{1,6}})", 1), printed_number)
        return bound(F.call_function("instr", contents, x), lambda at: F.when(at > 0, number(at)))

    # The first that gives a page; what comes after it is not looked up.
    return F.aggregate(tried, F.lit(None).cast("int"), lambda n, x: F.when(n.isNotNull(), n).otherwise(page(x)))


def contents_anchors(pages: DataFrame, vote: bool = False) -> DataFrame:
    """(book, mapping): the earliest page whose heading an earlier page of contents lists with a number.

    With `vote`, only headings count whose scan lies as far from its page as most headings of the book do (two pages a scan; of equal
    numbers of votes the smaller distance), so misread numbers are outvoted.
    """
    plain = pages.select("book", "scan", nfkc(F.coalesce("text", F.lit(""))).alias("text"))
    contents = plain.filter(_is_contents(F.col("text"))).select("book", F.col("scan").alias("listed"), _form(F.col("text")).alias("contents"))
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(h), 0) for h in HEADINGS]))
    named = F.array_distinct(F.filter(F.transform(found, lambda h: F.btrim(h, F.lit(_EDGES))), lambda h: F.length(_form(h)) >= 2))
    heads = plain.filter(~_is_contents(F.col("text"))).select("book", "scan", F.explode(named).alias("heading"))
    # As elements of an array the pages are not computed once more for a filter.
    listed = F.explode(F.array_compact(F.array(_listed_page(F.col("contents"), F.col("heading"))))).alias("page")
    anchors = heads.join(contents, "book").filter("listed < scan").select("book", "scan", listed)
    if vote:
        anchors = anchors.withColumn("off", F.col("scan") - F.floor(F.col("page") / 2))
        votes = anchors.groupBy("book", "off").agg(F.count("*").alias("votes"))
        won = votes.groupBy("book").agg(F.min_by("off", F.struct(-F.col("votes"), "off")).alias("off"))
        anchors = anchors.join(won, ["book", "off"])
    best = anchors.groupBy("book").agg(F.min(F.struct("page", "scan")).alias("a"))
    return best.select("book", F.col("a.scan").alias("anchor_scan"), F.col("a.page").alias("anchor_book"), F.lit(2).alias("pages_per_scan"), F.lit("front_matter_toc_heading").alias("method"), F.lit(0.82).alias("confidence"))


def lone_numbers(text: Column) -> Column:
    """Sorted distinct numbers, 1 to 3000, that stand alone on a line of normalized text."""
    marks = " \t\x0b\f.-—_　"
    # Whole lines of nothing but marks and numerals, found in one pass; all else is not looked at line by line.
    lines = F.regexp_extract_all(text, F.lit(rf"(?<![^\n\r])[ \t\x0B\f.\-—_　0-9Oo{_DIGITS}{_UNITS}]++(?![^\n\r])"), 0)
    numerals = F.transform(lines, lambda x: F.translate(x, marks, ""))
    values = F.transform(numerals, lambda x: F.when(x.rlike("^[0-9]{1,4}$"), x.cast("int")).otherwise(printed_number(x)))
    return F.array_sort(F.array_distinct(F.filter(values, lambda n: n.between(1, 3000))))


def visible_anchors(pages: DataFrame) -> DataFrame:
    """(book, mapping) of books with printed numbers on three scans at least: the usual growth a scan, and the first scan that shows a run of numbers."""
    texts = pages.select("book", "scan", nfkc(F.coalesce("text", F.lit(""))).alias("text"))
    # As elements of an array the numbers are not computed once more for the filter; dealt by book before they part, they are computed once for both sides.
    enough = F.filter(F.array(lone_numbers(F.col("text"))), lambda n: F.size(n) >= 2)
    scans = spread(texts.select("book", "scan", F.explode(enough).alias("numbers")), "book")
    order = Window.partitionBy("book").orderBy("scan")
    seen = scans.withColumns({"scans": F.count("*").over(Window.partitionBy("book")), "most": F.array_max("numbers")}).filter("scans >= 3")
    steps = seen.select("book", (F.col("scan") - F.lag("scan").over(order)).alias("by"), (F.col("most") - F.lag("most").over(order)).alias("grown"))
    rates = steps.filter("by > 0 AND grown > 0").select("book", F.rint(F.col("grown") / F.col("by")).cast("int").alias("rate")).filter("rate BETWEEN 1 AND 16")
    place = rates.withColumns({"at": F.row_number().over(Window.partitionBy("book").orderBy("rate")), "of": F.count("*").over(Window.partitionBy("book"))})
    usual = place.filter("at = of div 2 + 1").select("book", F.col("rate").alias("per"))

    def run(first: Column) -> Column:
        held = F.filter("numbers", lambda n: (n >= first) & (n < first + F.col("per")))
        return F.struct(F.size(held).alias("n"), (F.array_max(held) - first + 1).alias("span"), F.array_max(held).alias("last"))

    rows = seen.select("book", "scan", "numbers").join(usual, "book").withColumn("best", F.array_max(F.transform("numbers", run)))
    few = F.col("per") <= 2
    least = F.when(few, 2).otherwise(F.greatest(F.lit(3), F.least(F.lit(5), F.floor(F.col("per") / 2) + 1)))
    span = F.when(few, F.col("per")).otherwise(F.greatest(F.lit(2), F.col("per") - 2))
    fit = rows.filter((F.col("best.n") >= least) & (F.col("best.span") >= span))
    first = fit.groupBy("book").agg(F.min(F.struct("scan", "best", "per")).alias("a"))
    return first.select("book", F.col("a.scan").alias("anchor_scan"), F.greatest(F.lit(1), F.col("a.best.last") - F.col("a.per") + 1).alias("anchor_book"), F.col("a.per").alias("pages_per_scan"), F.lit("visible_page_number_lines").alias("method"), F.lit(0.7).alias("confidence"))


def _packed(mappings: DataFrame, name: str, *keys: str) -> DataFrame:
    held = [F.col(c) if c in mappings.columns else F.lit(None).alias(c) for c in MAPPING]
    typed = F.struct(*(c.cast(kind).alias(n) for c, n, kind in zip(held, MAPPING, ("int", "int", "int", "string", "double"))))
    return mappings.select(*keys, typed.alias(name))


def inferred_mappings(pages: DataFrame, vote: bool = False) -> DataFrame:
    """(book, mapping): printed numbers where more than two pages are on a scan, else contents, else printed numbers."""
    shown, listed = _packed(visible_anchors(pages), "v", "book"), _packed(contents_anchors(pages, vote), "c", "book")
    both = shown.join(listed, "book", "full_outer")
    chosen = F.when(F.col("v.pages_per_scan") > 2, F.col("v")).otherwise(F.coalesce("c", "v"))
    return both.select("book", chosen.alias("m")).select("book", "m.*")


def mapped_ranges(sources: DataFrame, inferred: DataFrame, cache: DataFrame, source_cache: DataFrame, failures: DataFrame, window: int = 2) -> DataFrame:
    """sources (id, book, source_key, pages) with origin, note, mapping and the scans to fetch, by the chain failures, cache, source cache, inference.

    A hard failure ends the search, a soft one is noted. A cached mapping yields to an inferred one that has another number of pages a scan, above
    two. `source_cache` (source_key, book, mapping) holds for the book it names, or for all if that is null. Without cited pages there is no range.
    """
    rows = sources.join(failures.select("book", F.col("reason").alias("_reason")), "book", "left")
    rows = rows.join(_packed(cache, "_cached", "book"), "book", "left").join(_packed(inferred, "_found", "book"), "book", "left")
    named = _packed(source_cache.withColumnRenamed("book", "_book"), "_named", "source_key", "_book")
    rows = rows.join(named, "source_key", "left")
    hard = F.lit(False)
    for mark in HARD_FAILURES:
        hard = hard | F.contains(F.lower("_reason"), F.lit(mark))
    hard = F.coalesce(hard, F.lit(False))
    other = F.col("_book").isNotNull() & (F.col("_book") != F.col("book"))
    per = lambda m: F.least(F.greatest(F.coalesce(F.nullif(F.col(f"{m}.pages_per_scan"), F.lit(0)), F.lit(2)), F.lit(1)), F.lit(16))
    better = F.col("_cached").isNotNull() & F.col("_found").isNotNull() & (per("_found") != per("_cached")) & (per("_found") > 2)
    source = F.when(~other, F.col("_named"))
    origin = F.when(hard, "failed").when(better, "refined").when(F.col("_cached").isNotNull(), "cache").when(source.isNotNull(), "source_cache").when(F.col("_found").isNotNull(), "inferred").otherwise("none")
    mapping = F.when(hard, None).when(better, F.col("_found")).otherwise(F.coalesce("_cached", source, "_found"))
    note = F.when(hard, F.concat(F.lit("page_mapping_skipped_after_failure:"), "_reason")).when(F.col("_reason").isNotNull(), F.concat(F.lit("page_mapping_retry_after_soft_failure:"), "_reason")).when(other & F.col("_cached").isNull(), F.concat_ws("", F.lit("source_level_page_mapping_cache_pid_mismatch:"), F.col("_book").cast("string"), F.lit("!="), F.col("book").cast("string")))
    rows = rows.withColumns({"origin": origin, "note": note, "_m": mapping})
    rows = rows.withColumn("_per", per("_m"))
    low, high = F.when(F.size("pages") > 0, F.greatest(F.lit(1), F.array_min("pages") - window)), F.array_max("pages") + window
    at = lambda page: F.when(page.isNotNull(), F.col("_m.anchor_scan") + F.greatest(F.lit(0), F.floor((page - F.col("_m.anchor_book")) / F.col("_per"))).cast("int"))
    shown = F.array_compact(F.transform("pages", lambda p: scan_page(p, F.col("_m.anchor_scan"), F.col("_m.anchor_book"), F.col("_per"))))
    return rows.select(*sources.columns, "origin", "note", F.col("_m.anchor_scan").alias("anchor_scan"), F.col("_m.anchor_book").alias("anchor_book"), F.when(F.col("_m").isNotNull(), F.col("_per")).alias("pages_per_scan"), at(low).alias("start_scan"), F.greatest(at(low), at(high)).alias("end_scan"), F.when(F.col("_m").isNotNull(), shown).alias("cited_scans"))
