"""Workflow tables: entity merging and relations, page assembly, OCR statistics, review reasons, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import scan_page

def merged_entities(entities: DataFrame) -> DataFrame:
    """One row per (text, category, start, stop): the most confident; it is for review if that row is, or a later, less confident one is.

    Ordered input: `ord`. A later row with a higher confidence replaces what came before, its flag included.
    """
    keys = Window.partitionBy("text", "category", "start", "stop")
    best = F.max_by("ord", F.struct("confidence", (-F.col("ord")).alias("o"))).over(keys)
    rows = entities.withColumn("_best", best).filter(F.col("ord") >= F.col("_best"))
    merged = rows.groupBy("text", "category", "start", "stop").agg(F.max("confidence").alias("confidence"), F.bool_or("needs_review").alias("needs_review"))
    return merged


#: Cues of each kind of relation.
RELATION_CUES = {"located_in": ["位于", "在", "属于"], "participated_in": ["参加", "参与", "出席"], "founded": ["创建", "建立", "创立"], "ruled_by": ["统治", "支配", "管辖"]}


def relations(texts: DataFrame, cues: dict[str, list[str]] | None = None, text: str = "text", context: int = 160) -> DataFrame:
    """Rows with `place`, `relation`, `pattern` and `context` for every cue of every kind that a text holds, in order of the cues."""
    named = [(kind, word) for kind, words in (RELATION_CUES if cues is None else cues).items() for word in words]
    all_cues = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(kind).alias("relation"), F.lit(word).alias("pattern")) for k, (kind, word) in enumerate(named)])
    held = F.filter(all_cues, lambda c: F.contains(F.col(text), c["pattern"]))
    rows = texts.withColumn("_c", F.explode(held))
    return rows.withColumns({**{name: F.col(f"_c.{name}") for name in ("place", "relation", "pattern")}, "context": F.substring(text, 1, context)}).drop("_c")


def page_texts(blocks: DataFrame, key: str, wanted: int = 6) -> DataFrame:
    """(key, text, marked, missing, characters) of a page's blocks 1..wanted in order: trimmed texts with a blank line between, the same between marks, and the numbers that are not there.

    Other blocks, and blank ones, give no text; a block whose text is null is not there.
    """
    there = blocks.filter(F.col("text").isNotNull()).withColumn("_t", F.regexp_replace("text", r"^[\s　]+|[\s　]+$", ""))
    inside = F.col("block").between(1, wanted)
    ordered = F.array_sort(F.collect_list(F.when(inside & (F.col("_t") != ""), F.struct("block", "_t"))))
    rows = there.groupBy(key).agg(ordered.alias("b"), F.collect_set(F.when(inside, F.col("block").cast("int"))).alias("have"))
    text = F.array_join(F.transform("b", lambda x: x["_t"]), "\n\n")
    mark = lambda x, end: F.concat(F.lit(f"<{end}block_"), x["block"].cast("string"), F.lit(">"))
    marked = F.array_join(F.transform("b", lambda x: F.concat_ws("\n", mark(x, ""), x["_t"], mark(x, "/"))), "\n\n")
    return rows.select(key, text.alias("text"), marked.alias("marked"), F.array_except(F.sequence(F.lit(1), F.lit(wanted)), "have").alias("missing"), F.length(text).alias("characters"))


def ocr_statistics(pages: DataFrame) -> DataFrame:
    """total, success, failed, characters, mean of the successful, success rate in percent."""
    good = F.col("status") == "success"
    return pages.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.length("text"))), F.lit(0)).alias("characters"),
        F.coalesce(F.avg(F.when(good, F.length("text"))), F.lit(0.0)).alias("mean_characters"),
        F.round(F.coalesce(F.avg(F.when(good, 100.0).otherwise(0.0)), F.lit(0.0)), 2).alias("success_percent"),
    )


def entry_ids(lines: DataFrame, key: str, order: str, is_title: Column, is_heading: Column | None = None, most: int = 3) -> DataFrame:
    """entry: running number of the title line a line belongs to; 0 for lines before the first title.

    Heading lines right before a title, `most` at most, belong to that title's entry.
    """
    window = Window.partitionBy(key).orderBy(order)
    rows = lines.withColumns({"_title": F.coalesce(is_title, F.lit(False)), "_head": F.lit(False) if is_heading is None else F.coalesce(is_heading & ~is_title, F.lit(False))})
    pulled, run = F.lit(False), F.col("_head")
    for k in range(1, most + 1):
        pulled = pulled | (run & F.coalesce(F.lead("_title", k).over(window), F.lit(False)))
        run = run & F.coalesce(F.lead("_head", k).over(window), F.lit(False))
    rows = rows.withColumn("_pulled", pulled)
    fresh = (F.col("_pulled") | F.col("_title")) & ~F.coalesce(F.lag("_pulled").over(window), F.lit(False))
    rows = rows.withColumn("_fresh", fresh.cast("int"))
    return rows.withColumn("entry", F.sum("_fresh").over(window)).drop("_title", "_head", "_pulled", "_fresh")


def visible_page_numbers(text: Column) -> Column:
    """Numbers that stand alone on a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t\-]*(\d{1,4})[ \t\-]*$"), 1), lambda n: n.cast("int"))


def cleaned_ocr(text: Column) -> Column:
    """Full-width spaces and runs of spaces become one, lines are trimmed, lone page-number lines and control characters go."""
    text = F.regexp_replace(F.translate(text, "　\xa0", "  "), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    text = F.regexp_replace(text, r"(?m)^[ \t\-]*\d{1,4}[ \t\-]*$\n?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ | $", ""))


def numbered_references(parts: list[DataFrame]) -> DataFrame:
    """Reference lists one after another, under one running number, in order of list and `ord`."""
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("_list", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    sizes = [part.count() for part in parts]
    before = F.element_at(F.array(*[F.lit(sum(sizes[:k])) for k in range(len(parts))]), F.col("_list") + 1)
    within = F.row_number().over(Window.partitionBy("_list").orderBy("ord"))
    return rows.withColumn("number", before + within).drop("_list")


#: What notes tell about a source that has no text, in this order; `no_digital_pid` yields to a blocked page mapping.
NOTED_REASONS = (("remote_copy_only_no_print", "remote_copy_only_no_print"), ("restricted_download_skipped_no_ndl_pid", "no_digital_pid"), ("download_not_pdf", "download_not_pdf"), ("download_http_404", "download_http_404"), ("download_http_403", "download_http_403"), ("print_button_not_found", "print_button_not_found"), ("download_link_not_found", "download_link_not_found"))
#: Reasons that a blocked page mapping explains away.
MAPPING_REASONS = ("no_digital_pid", "mapped_page_out_of_scan_range", "downloaded_page_range_adjusted")


def unavailable_reason(has_text: Column, status: Column, reason: Column, notes: Column, failures: Column, mapping_blocked: Column) -> Column:
    """Why a source has no text: the availability that is known, else what its notes say, else a failed download; null if it has text or nothing is known."""
    blocked = F.coalesce(mapping_blocked, F.lit(False))
    known = F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown"))
    noted = F.lit(None).cast("string")
    for mark, name in reversed(NOTED_REASONS):
        told = F.coalesce(F.contains(notes, F.lit(mark)), F.lit(False))
        noted = F.when(told & ~blocked if name == "no_digital_pid" else told, name).otherwise(noted)
    failed = F.when(F.contains(failures, F.lit(NOTED_REASONS[0][0])), NOTED_REASONS[0][1])
    listed = F.coalesce(status == "unavailable", F.lit(False))
    return F.when(F.coalesce(has_text, F.lit(False)), None).when(listed, F.when(~(blocked & known.isin(*MAPPING_REASONS)), known)).otherwise(F.coalesce(noted, failed))


def merged_hints(matches: DataFrame, key: str) -> DataFrame:
    """(key, routes, score, hints): sorted distinct routes, best score, distinct (snippet, page) hints."""
    rows = matches.select(key, "route", "score", F.explode_outer("hints").alias("_hint"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("route")).alias("routes"), F.max("score").alias("score"), F.array_sort(F.collect_set("_hint")).alias("hints"))


def literature_split(works: DataFrame, year: str, this_year: int, k: int = 8) -> DataFrame:
    """kind: the k earliest classics (year unknown or over 15 years back) and the k latest others."""
    y = F.col(year)
    old = y.isNull() | (y.cast("int") < this_year - 15)
    classic = works.filter(old).orderBy(F.coalesce(y, F.lit("")), "id").limit(k).withColumn("kind", F.lit("classic"))
    frontier = works.filter(~old).orderBy(F.desc(year), "id").limit(k).withColumn("kind", F.lit("frontier"))
    return classic.unionByName(frontier)


def download_plan(sources: DataFrame, window: int = 2) -> DataFrame:
    """Sources (pages, and a mapping: anchor_scan, anchor_book, pages_per_scan, start_scan, end_scan or nulls) with from_page, to_page, mapped and note.

    A mapping that reaches a cited page gives its own range of scans; else the pages themselves with `window` more on either side. No pages: page 1.
    """
    pages = F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array(F.lit(1)))
    at = F.array_compact(F.transform(pages, lambda p: scan_page(p, F.col("anchor_scan"), F.col("anchor_book"), F.coalesce("pages_per_scan", F.lit(2)))))
    mapped = F.when(F.col("anchor_scan").isNotNull() & F.col("anchor_book").isNotNull(), at).otherwise(F.array().cast("array<int>"))
    used = F.size(mapped) > 0
    low = F.when(used, F.col("start_scan")).otherwise(F.greatest(F.lit(1), F.array_min(pages) - window))
    high = F.when(used, F.col("end_scan")).otherwise(F.array_max(pages) + window)
    note = F.when(used, F.concat(F.lit("double_page_mapping_used: book_p"), F.col("anchor_book").cast("string"), F.lit("->scan_p"), F.col("anchor_scan").cast("string"))).otherwise("")
    return sources.withColumns({"from_page": low, "to_page": high, "mapped": mapped, "note": note})
