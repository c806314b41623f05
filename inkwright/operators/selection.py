"""Selecting, ordering and merging results; summaries of runs and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import in_rows


def selected_items(results: DataFrame, status: str | None = None, downloadable: bool | None = None) -> DataFrame:
    """Results of one status and with or without a source to download; `offset` and the rest stay."""
    out = results if status is None else results.filter(F.col("status") == status)
    return out if downloadable is None else out.filter(F.coalesce(F.col("downloadable"), F.lit(False)) == downloadable)


def recheck_items(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status").isin("source_mismatch", "source_not_found"))


def merged_search(groups: list[DataFrame], limit: int) -> DataFrame:
    """The best `limit` of several sources' rows (id, score, ordinal), the sources in the given order where scores are equal."""
    out = None
    for k, rows in enumerate(groups):
        named = rows.withColumn("source_rank", F.lit(k))
        out = named if out is None else out.unionByName(named)
    return out.orderBy(F.desc("score"), "source_rank", "ordinal").limit(limit)


def ordered_matches(matches: DataFrame, group: str, low: Column, high: Column) -> DataFrame:
    """Matches (group, ordinal, pages, digital, score) with `place`: those with a wanted page first, then digital ones, then by score.

    A wanted page is one from `low` to `high`.
    """
    page_rank = F.when(F.exists("pages", lambda p: (p >= low) & (p <= high)), 0).otherwise(1)
    order = Window.partitionBy(group).orderBy(page_rank, F.when(F.col("digital"), 0).otherwise(1), F.desc("score"), "ordinal")
    return matches.withColumn("place", F.row_number().over(order))


def result_order(refinement: Column, candidate_id: Column) -> Column:
    """The number a result is ordered by: its refinement offset, else the first number in its id, else 999999."""
    number = F.regexp_extract(candidate_id, r"(\d+)", 1)
    return F.coalesce(refinement.cast("long"), F.when(F.length(number) > 0, number.cast("long")), F.lit(999999).cast("long"))


def merged_payloads(results: DataFrame) -> DataFrame:
    """Results (payload, ordinal, candidate_id, refinement) of several payloads, each id once, with `duplicates` and their `place` in the whole.

    The last payload's row of an id stays. The place is a running number over all results, so it takes a sort of ids alone.
    """
    last = Window.partitionBy("candidate_id").orderBy(F.desc("payload"), F.desc("ordinal"))
    count = F.count("*").over(Window.partitionBy("candidate_id"))
    kept = results.withColumns({"_r": F.row_number().over(last), "duplicates": count - 1}).filter("_r = 1").drop("_r")
    return kept.withColumn("order_key", result_order(F.col("refinement"), F.col("candidate_id")))


def experiences_by_start(experiences: Column) -> Column:
    """Experiences (start, ...) by start, those without one last; `start` is the first field."""
    dated = F.filter(experiences, lambda e: e["start"].isNotNull())
    return F.concat(F.array_sort(dated), F.filter(experiences, lambda e: e["start"].isNull()))


def checkpoint_summary(results: DataFrame, total: int) -> DataFrame:
    """(measure, n): processed and remaining candidates, sources found, every status, refined and support status, and the five review counters."""
    flags = ["eligible_for_llm_review", "llm_review_success", "llm_review_json_repaired", "llm_review_fallback_heuristic", "llm_review_failed"]
    processed = F.count("*")
    one = results.agg(F.lit(total).cast("long").alias("total_candidates"), processed.alias("processed_candidates"), F.greatest(F.lit(total) - processed, F.lit(0)).cast("long").alias("remaining_candidates"), F.count_if(F.col("matches") > 0).alias("source_found"), *[F.count_if(F.col(f)).alias(f"llm:{f}") for f in flags])
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").alias("n")) for c in one.columns])
    out = one.select(F.inline(pairs)).filter("n > 0 OR measure NOT LIKE 'llm:%'")
    kinds = F.array(F.coalesce("status", F.lit("unknown")), F.concat(F.lit("support:"), F.coalesce("support_status", F.lit("unassessed"))), F.concat(F.lit("refined:"), F.col("refined_status")))
    return out.unionByName(results.select(F.explode(kinds).alias("measure")).filter("measure IS NOT NULL").groupBy("measure").agg(F.count("*").alias("n")))


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """(kind, name, n) of artifacts (type, stage): in all, by type, and by stage where there is one."""
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")),
        F.struct(F.lit("type").alias("kind"), F.coalesce("type", F.lit("unknown")).alias("name")),
        F.struct(F.lit("stage").alias("kind"), F.concat(F.lit("stage"), F.col("stage").cast("string")).alias("name")),
    )
    return artifacts.select(F.inline(kinds)).filter("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


def open_reviews(queue: DataFrame) -> DataFrame:
    """One row: review items, and those that are open (no status counts as open)."""
    return queue.agg(F.count("*").alias("review_queue_count"), F.count_if(F.coalesce("status", F.lit("open")) == "open").alias("open_review_count"))


def mean_score(scores: DataFrame, group: str) -> DataFrame:
    """(group, confidence): the mean of the scores of an answer's passages; 0 without any."""
    return scores.groupBy(group).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"))


def effective_score(score: Column, known: Column, volume: Column, download: Column, hinted: Column, specificity: Column) -> Column:
    """Score of a source match with what speaks for it: a known id, a volume that agrees, a download, full-text hints."""
    return score + F.when(known, 0.70).otherwise(0.0) + F.when(volume, 0.25).otherwise(0.0) + F.when(download, 0.12).otherwise(0.0) + F.when(hinted, 0.10 + specificity).otherwise(0.0)


def hint_specificity(hints: Column, contained: Column, host: Column, title: Column, volumes: Column) -> Column:
    """The best of the hints (query, snippet, has_page): which of the names it holds; 0 without any."""

    def holds(h: Column, term: Column) -> Column:
        return (F.length(term) > 0) & (F.contains(h["query"], term) | F.contains(h["snippet"], term))

    def value(h: Column) -> Column:
        parts = [(holds(h, contained), 0.45), (holds(h, host), 0.20), ((title != contained) & holds(h, title), 0.15), (F.exists(volumes, lambda v: holds(h, v)), 0.30), (h["has_page"], 0.05)]
        return sum((F.when(test, weight).otherwise(0.0) for test, weight in parts), F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(hints, value)), F.lit(0.0))


def source_priority(known: Column, pdf: Column, download: Column, hinted: Column, routes: Column) -> Column:
    """0 to 4, the smaller the better: known ids and PDFs, downloads, hints of the digital full text, others, hints of the catalogue's text."""
    html = F.array_contains(routes, "html_fulltext")
    return F.when(known | pdf | F.array_contains(routes, "resolver_config"), 0).when(download & ~html, 1).when(hinted & F.array_contains(routes, "digital_fulltext"), 2).when(html, 4).otherwise(3)


def deduplication_key(parts: list[Column]) -> Column:
    """The parts as one string, empty where there is none, parted by the unit separator."""
    return F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps as one; of a key in both the right one's value counts."""
    left, right = (F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for m in (left, right))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def validated_output(value: Column, ok: Column) -> Column:
    """(confidence, needs_review, flags) of a text output: none or blank ones are empty and need a review."""
    blank = value.isNotNull() & (F.length(F.trim(F.regexp_replace(value, r"\s+", " "))) == 0)
    sure = F.when(ok, 1.0).otherwise(0.0)
    confidence = F.when(value.isNull(), 0.0).when(blank, F.least(sure, F.lit(0.2))).otherwise(sure)
    flags = F.when(value.isNull() | blank, F.array(F.lit("empty_output"))).otherwise(F.array().cast("array<string>"))
    return F.struct(confidence.alias("confidence"), (~ok | value.isNull() | blank).alias("needs_review"), flags.alias("flags"))


def merged_rows(lines: DataFrame, page: str, tolerance: float = 3.2) -> DataFrame:
    """(page, row, text, size) of lines (page, ordinal, y, text, size): one row as long as y is within `tolerance` of the row's first line.

    The size of a row is the mean weighted by text length. A row's first line decides, so lines are numbered in one pass over sorted partitions.
    """
    rows = lines.select(page, "ordinal", F.col("y").cast("double").alias("y"), "text", F.col("size").cast("double").alias("size"))
    ordered = rows.repartition(page).sortWithinPartitions(page, "ordinal")
    numbered = in_rows(ordered, [page], "y", tolerance)
    weight = F.length("text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("text").alias("t")))), lambda s: s["t"]), "")
    return numbered.groupBy(page, "row").agg(text.alias("text"), (F.sum(F.col("size") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("size"))


def stored_ids(chunks: DataFrame, document: int | str | None = None) -> DataFrame:
    """Ids of all chunks, or of one document's."""
    rows = chunks if document is None else chunks.filter(F.col("document_id") == document)
    return rows.select("chunk_id", "document_id")


def stored_upsert(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """The store with `more` added; of equal chunk ids the added one stays."""
    return chunks.join(more.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(more)


def host_titles(titles: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """(key, host): hosts of `hosts` (contained, host) whose contained title equals the title or is a part of either.

    `hosts` is a table of rules; it meets each title in one array, so it has to fit in one row.
    """
    rules = hosts.agg(F.array_sort(F.collect_set(F.struct("contained", "host"))).alias("_rules"))
    rows = titles.join(F.broadcast(rules))
    fits = F.filter("_rules", lambda r: (F.length(r["contained"]) > 0) & (F.length("title") > 0) & (F.contains("title", r["contained"]) | F.contains(r["contained"], F.col("title"))))
    return rows.select(key, F.explode(F.array_distinct(F.transform(fits, lambda r: r["host"]))).alias("host"))


def page_groups(pages: DataFrame, key: str, size: int = 50) -> DataFrame:
    """(key, group, first, last, text): pages (key, page from 0, text) in groups of `size`, their texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    grouped = pages.groupBy(key, F.floor(F.col("page") / size).cast("long").alias("group")).agg(F.min("page").alias("first"), F.max("page").alias("last"), ordered.alias("_p"))
    return grouped.select(key, "group", "first", "last", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"))


def text_totals(pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, words, characters) of recognised pages."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum(words).alias("words"), F.sum(F.length("text")).alias("characters"))


def speech_statistics(speeches: DataFrame, most: int = 10) -> DataFrame:
    """(measure, name, n): speeches in all, by kind, and those of the `most` frequent named speakers; the name orders equal ones."""
    total = speeches.agg(F.lit("speeches").alias("measure"), F.lit("").alias("name"), F.count("*").alias("n"))
    kinds = speeches.groupBy(F.lit("kind").alias("measure"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    named = speeches.filter(F.length("speaker") > 0).groupBy("speaker").agg(F.count("*").alias("n"))
    best = named.orderBy(F.desc("n"), "speaker").limit(most).select(F.lit("speaker").alias("measure"), F.col("speaker").alias("name"), "n")
    return total.unionByName(kinds).unionByName(best)


def partial_progress(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """(run, expected, done, complete): how many of a run's expected ids (run, id) its partial results (run, id) hold."""
    done = parts.select("run", "id").distinct().withColumn("_d", F.lit(1))
    rows = expected.select("run", "id").distinct().join(done, ["run", "id"], "left")
    return rows.groupBy("run").agg(F.count("*").alias("expected"), F.count("_d").alias("done")).withColumn("complete", F.col("done") == F.col("expected"))


def collected_works(lists: list[DataFrame]) -> DataFrame:
    """Works (id, title, ordinal, ...) of several lists, each once by its id or else its title's first 80 characters; the first one stays."""
    rows = None
    for k, some in enumerate(lists):
        some = some.withColumn("_list", F.lit(k))
        rows = some if rows is None else rows.unionByName(some)
    name = F.coalesce(F.nullif("id", F.lit("")), F.substring("title", 1, 80))
    first = F.row_number().over(Window.partitionBy("_name").orderBy("_list", "ordinal"))
    return rows.withColumn("_name", name).withColumn("_r", first).filter("_r = 1").withColumn("id", F.col("_name")).drop("_name", "_r", "_list")


def compared_models(models: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """(model, query_id, id, score, rank): the k best of each model's scores (query_id, id, score) per query."""
    rows = None
    for name, scores in models.items():
        some = scores.select(F.lit(name).alias("model"), "query_id", "id", "score")
        rows = some if rows is None else rows.unionByName(some)
    best = F.row_number().over(Window.partitionBy("model", "query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", best).filter(F.col("rank") <= k)


def person_rows(persons: DataFrame, most: int = 3) -> DataFrame:
    """Persons (name, hometown, education, experiences, page, text) as flat rows: the first experiences in columns of their own, the text cut to 100 characters."""
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "hometown", "education")]
    for k in range(most):
        columns += [F.coalesce(F.get("experiences", F.lit(k))[field], F.lit("")).alias(f"{field}_{k + 1}") for field in ("unit", "date_range", "description")]
    return persons.select(*columns, "page", F.substring("text", 1, 100).alias("text"))


def person_lines(pages: DataFrame) -> DataFrame:
    """One JSON line for each person of pages (page, persons), with the page in front."""
    rows = pages.select("page", F.explode("persons").alias("_p"))
    return rows.select(F.to_json(F.struct("page", "_p.*")).alias("value"))


def speech_notes(speeches: DataFrame, key: str, order: str) -> DataFrame:
    """(key, markdown): numbered speeches (kind, speaker, text, confidence) of a page; texts cut to 200 characters."""
    item = F.concat_ws("\n", F.concat(F.lit("**"), F.col("_n").cast("string"), F.lit(". "), "kind", F.lit("**")), F.when(F.length("speaker") > 0, F.concat(F.lit("- 发言者: "), "speaker")), F.concat(F.lit("- 内容: "), F.substring("text", 1, 200), F.lit("...")), F.format_string("- 置信度: %.2f", "confidence"), F.lit(""))
    rows = speeches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).select(key, F.struct("_n", item.alias("i")).alias("_s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["i"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit("## 第"), F.col(key).cast("string"), F.lit("页\n\n### 发言内容\n"), body).alias("markdown"))
