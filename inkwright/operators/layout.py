"""Papers from lines with places: rows, the footnote zone, body text with its notes, and the parts of a paper's text.

Lines have (doc, page, height, x0, y0, x1, y1, size, text): the page's height, the line's box, its mean font size. A page's lines are few, so a page is
handled whole; documents and pages are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import collapse

#: What a footnote begins with, and the largest mean font size of one.
NOTE_START = r"^(\*|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|[-][^\s　、，：:]{0,4})[\s　]*"
NOTE_SIZE = 11.6
#: Fixed values of the layout, in points: tolerance of a row, gap that parts lines, heights of heads and feet.
ROW, GAP, HEAD, FOOT, LOW = 3.2, 18, 44, 80, 35


def in_rows(ordered: DataFrame, page: list[str], y: str, tolerance: float) -> DataFrame:
    """Sorted partitions of whole pages with `row`: the next one whenever y is further than `tolerance` from the first line of a row."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, row = None, 0.0, 0
        for batch in batches:
            rows, fresh = [], np.zeros(batch.num_rows, bool)
            for c in page:
                code = batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= code[1:] != code[:-1]
            if batch.num_rows:
                fresh[0] = held != [batch[c][0].as_py() for c in page]
                held = [batch[c][-1].as_py() for c in page]
            for begins, at in zip(fresh.tolist(), batch[y].to_pylist()):
                if begins:
                    first, row = at, 0
                elif abs(first - at) > tolerance:
                    first, row = at, row + 1
                rows.append(row)
            yield batch.append_column("row", pa.array(rows, pa.int32()))

    return ordered.mapInArrow(number, StructType([*ordered.schema.fields, StructField("row", IntegerType())]))


def page_rows(lines: DataFrame, tolerance: float = ROW) -> DataFrame:
    """Lines whose y0 is within `tolerance` of the first of their row, from top to bottom, as one row from left to right.

    The size of a row is the mean of its lines' sizes by text length. A row's first line decides, so lines are numbered in one pass over sorted
    partitions; pages stay whole in them.
    """

    rows = lines.select(*(F.col(c).cast("long").alias(c) for c in ("doc", "page")), *(F.col(c).cast("double").alias(c) for c in ("height", "x0", "y0", "x1", "y1", "size")), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("doc", "page").sortWithinPartitions("doc", "page", F.round("y0", 1), "x0", "text")
    numbered = in_rows(ordered, ["doc", "page"], "y0", tolerance)
    length = F.greatest(F.length("text"), F.lit(1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "text"))), lambda x: x["text"]), "")
    ends = [F.max("height").alias("height"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return numbered.groupBy("doc", "page", "row").agg(*ends, (F.sum(F.col("size") * length) / F.sum(length)).alias("size"), F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "").alias("text"))


def zoned_rows(rows: DataFrame) -> DataFrame:
    """Rows with `zone`: body, note, or null for running heads, page numbers and what is below the notes.

    Notes begin at the first small line in the lower part that starts with a note's mark, else at the first small line near the left edge further down.
    """
    number = F.col("text").rlike("^[0-9]{1,4}$") & ((F.col("y0") > F.col("height") - FOOT) | (F.col("y0") < HEAD))
    small = F.col("size") <= NOTE_SIZE
    page = Window.partitionBy("doc", "page")
    marked = F.min(F.when((F.col("y0") > F.col("height") * 0.55) & small & F.col("text").rlike(NOTE_START), F.col("y0"))).over(page)
    plain = F.min(F.when((F.col("y0") > F.col("height") * 0.70) & small & (F.col("x0") < 140) & ~number, F.col("y0"))).over(page)
    rows = rows.withColumn("notes_from", F.coalesce(marked - 2, plain - 2, F.col("height") + 1))
    head = (F.col("y0") < HEAD) & (F.length("text") <= 24)
    body = (F.col("y0") < F.col("notes_from")) & ~number & ~head
    note = (F.col("y0") >= F.col("notes_from")) & (F.col("y0") < F.col("height") - LOW) & ~number
    return rows.withColumn("zone", F.when(body, "body").when(note, "note"))


def repeated_heads(rows: DataFrame, share: float = 0.5, least: int = 3, step: float = 4.0) -> DataFrame:
    """(doc, text, y0, pages): texts, but for their numbers, that stand at one height on the given share of a document's pages.

    Heights are one as long as no gap between neighbouring ones exceeds `step`.
    """
    shape = F.trim(F.regexp_replace("text", r"\d+", "#"))
    order = Window.partitionBy("doc", "text").orderBy("y0", "page")
    lines = rows.select("doc", "page", shape.alias("text"), "y0").filter("text <> ''")
    lines = lines.withColumn("_new", F.coalesce(F.col("y0") - F.lag("y0").over(order) > step, F.lit(False)).cast("int")).withColumn("_at", F.sum("_new").over(order))
    pages = rows.groupBy("doc").agg(F.count_distinct("page").alias("_all"))
    found = lines.groupBy("doc", "text", "_at").agg(F.min("y0").alias("y0"), F.count_distinct("page").alias("pages"))
    return found.join(pages, "doc").filter((F.col("pages") >= least) & (F.col("pages") >= F.col("_all") * share)).select("doc", "text", "y0", "pages")


def page_notes(zoned: DataFrame) -> DataFrame:
    """(doc, page, note_id, number, mark, text): notes of each page; lines before the first mark belong to none."""
    order = Window.partitionBy("doc", "page").orderBy("row")
    mark = F.regexp_extract("text", NOTE_START, 1)
    lines = zoned.filter("zone = 'note'").withColumn("mark", mark).withColumn("number", F.sum((F.col("mark") != "").cast("int")).over(order)).filter("number > 0")
    rest = F.trim(F.regexp_replace("text", NOTE_START, ""))
    said = F.when((F.col("mark") != "") & (rest != ""), rest).otherwise(F.trim("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", said.alias("t")))), lambda x: x["t"]), "")
    out = lines.groupBy("doc", "page", "number").agg(collapse(joined).alias("text"), F.max("mark").alias("mark"))
    return out.withColumns({"number": F.col("number").cast("int"), "note_id": F.format_string("p%dn%d", "page", "number")})


def paper_pages(zoned: DataFrame) -> DataFrame:
    """(doc, page, text, notes, flags): the body of each page without note marks, (note_id, position) of each mark in it, and what is odd about them.

    A mark that several notes of a page have stands for the last of them.
    """
    # Rows are read once: body and notes are ordered each for itself and meet in one grouping of their page. A note is a row with a mark.
    kind = F.when((F.col("zone") == "body") & (F.col("text") != ""), "body").when(F.col("zone") == "note", "note")
    lines = zoned.withColumns({"_kind": kind, "_mark": F.when(F.col("zone") == "note", F.regexp_extract("text", NOTE_START, 1)).otherwise("")})
    order = Window.partitionBy("doc", "page", "_kind").orderBy("row")
    lines = lines.withColumns({"_gap": F.col("y0") - F.lag("y0").over(order) > GAP, "_number": F.sum((F.col("_mark") != "").cast("int")).over(order)})
    said = F.concat(F.when(F.col("_gap"), "\n").otherwise(""), F.trim("text"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_kind") == "body", F.struct("row", said.alias("t")))))
    body = F.when(F.size(ordered) > 0, collapse(F.array_join(F.transform(ordered, lambda x: x["t"]), "")))
    found = F.array_sort(F.collect_list(F.when(F.col("_mark") != "", F.struct((-F.length("_mark")).alias("o"), F.col("_mark").alias("mark"), F.col("_number").alias("number")))))
    pages = lines.groupBy("doc", "page").agg(body.alias("_body"), found.alias("_found_notes"))
    # In this order the last note of a mark stands before another mark.
    last = F.filter("_found_notes", lambda x, k: ~F.coalesce(F.get(F.col("_found_notes"), k + 1)["mark"] == x["mark"], F.lit(False)))
    marks = F.transform(last, lambda x: F.struct(x["o"], x["mark"], F.format_string("p%dn%d", F.col("page"), x["number"]).alias("note_id")))
    some = F.size("_found_notes") > 0
    pages = pages.withColumns({"_marks": F.when(some, marks), "_notes": F.when(some, F.size("_found_notes"))})
    pattern = F.coalesce(F.nullif(F.array_join(F.transform("_marks", lambda m: F.concat(F.lit(r"\Q"), m["mark"], F.lit(r"\E"))), "|"), F.lit("")), F.lit("(?!)"))
    text = F.coalesce("_body", F.lit(""))
    pages = pages.withColumns({"_parts": F.call_function("split", text, pattern, F.lit(-1)), "_found": F.regexp_extract_all(text, pattern, F.lit(0))})
    place = lambda k: F.aggregate(F.slice("_parts", F.lit(1), k + 1), F.lit(0), lambda s, p: s + F.length(p))
    by_mark = F.map_from_entries(F.transform("_marks", lambda m: F.struct(m["mark"], m["note_id"])))
    found = F.transform("_found", lambda m, k: F.struct(F.try_element_at(by_mark, m).alias("note_id"), place(k).alias("position")))
    pages = pages.withColumn("_refs", F.coalesce(found, F.array().cast("array<struct<note_id:string,position:int>>")))
    count, notes_here = F.size("_refs"), F.coalesce("_notes", F.lit(0))
    twice = count > F.size(F.array_distinct(F.transform("_refs", lambda r: r["note_id"])))
    flags = F.array_compact(F.array(F.when((notes_here > 0) & (count == 0), "pdf_page_footnotes_without_body_markers"), F.when(notes_here > count, "pdf_page_footnotes_exceed_body_markers"), F.when(twice, "pdf_page_duplicate_body_marker_reference")))
    return pages.select("doc", "page", collapse(F.array_join("_parts", "")).alias("text"), F.col("_refs").alias("notes"), flags.alias("flags"))


#: The parts of a paper and the headings they are known by, and what ends a part.
SECTIONS = {"abstract": ("abstract", "摘要"), "introduction": ("introduction", "引言", "介绍", "1 introduction"), "methodology": ("methodology", "method", "方法", "方法论", "2 method"), "results": ("results", "experiments", "结果", "实验", "3 results"), "conclusion": ("conclusion", "conclusions", "结论", "总结", "4 conclusion")}
_ENDS = r"(?=\n\d+\.?\s+[A-Z]|\n[A-Z][a-z]+\s*[:：]|\nReferences|\n参考文献|\n?\z)"
_HEADINGS = (r"{0}\s*[:：]?\s*\n(.+?)", r"\d+\.?\s*{0}\s*[:：]?\s*\n(.+?)", r"\n{0}\s*\n(.+?)")
_REFERENCES = (r"(?is)References\s*\n(.+)\z", r"(?is)参考文献\s*\n(.+)\z", r"(?is)\[\d+\]\s*(.+?)(?=\[\d+\]|\n?\z)")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def paper_title(first_page: Column) -> Column:
    """The first of five lines with 11 to 199 characters that is no heading, number or archive mark; else the first line."""
    lines = F.transform(F.split(_stripped(first_page), "\n"), _stripped)
    good = F.filter(F.slice(lines, 1, 5), lambda x: F.length(x).between(11, 199) & ~F.lower(x).rlike(r"^\d|^abstract|^keywords|^arxiv"))
    return F.coalesce(F.get(good, F.lit(0)), F.get(lines, F.lit(0)))


def paper_section(text: Column, headings: tuple[str, ...], most: int = 3000) -> Column:
    """Text below the first heading that is found, by heading and form, up to the next numbered or named part; empty without one."""
    tried = []
    for heading in headings:
        for form in _HEADINGS:
            pattern = "(?is)" + form.format(heading) + _ENDS
            tried.append(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)))
    return F.substring(_stripped(F.coalesce(*tried, F.lit(""))), 1, most)


def paper_references(text: Column) -> Column:
    """What follows the references' heading as one, else numbered references: of the first 30 those over 30 characters, 20 at most, 500 characters each."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in _REFERENCES]
    first = F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])
    kept = F.filter(F.transform(F.slice(first, 1, 30), _stripped), lambda r: F.length(r) > 30)
    return F.slice(F.transform(kept, lambda r: F.substring(r, 1, 500)), 1, 20)


def paper_structure(pages: DataFrame, key: str = "doc") -> DataFrame:
    """(key, title, abstract, introduction, methodology, results, conclusion, references, pages) of papers from (key, page, text).

    Title and abstract come from the first page.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"])
    papers = pages.groupBy(key).agg(ordered.alias("_p")).select(key, F.size("_p").alias("pages"), F.get("_p", F.lit(0)).alias("_first"), F.array_join("_p", "\n").alias("_all"))
    parts = {name: paper_section(F.col("_first" if name == "abstract" else "_all"), headings) for name, headings in SECTIONS.items()}
    return papers.select(key, paper_title(F.col("_first")).alias("title"), *(c.alias(n) for n, c in parts.items()), paper_references(F.col("_all")).alias("references"), "pages")
