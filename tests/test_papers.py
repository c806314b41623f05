"""Page mapping, paper layout, citation units, directory entries and the vector index on rows worked by hand, and against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwright.functions import dates as D
from inkwright.functions import text as T
from inkwright.operators import citation_units, entries, layout, summaries, vector_index, workflow
from inkwright.operators import page_mapping as P
from inkwright.operators.retrieval import batch_top_k
from inkwright.plans.files import place


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("token, number", [("45", 45), ("０", None), ("四五", 45), ("百二十三", 123), ("十", 10), ("二千三", 2003), ("一O", 10), ("12a", None), ("", None)])
def test_printed_numbers(spark, token, number):
    assert value(spark, P.printed_number(F.lit(token))) == number


def test_contents_mapping(spark):
    rows = [
        (1, 2, "目　次\n目次\n第一章 總論 …… 五\n第二章 歴史 …… 二十七\n緒言 …… 一"),
        (1, 6, "緒言\n本文"),
        (1, 8, "第一章　總論\n本文である"),
        (1, 19, "第二章 歴史 と後の文"),
        (2, 3, "第一章 前\n本文"),  # its contents come later, so they list nothing
        (2, 9, "目次\n第一章 前 …… 7"),
        (3, 1, "目次\n第一章 甲 …… 9\n第二章 乙 …… 11\n第三章 丙 …… 1"),  # the third number is misread
        (3, 7, "第一章 甲"),
        (3, 8, "第二章 乙"),
        (3, 12, "第三章 丙"),
        (4, 1, None),
    ]
    pages = spark.createDataFrame(rows, "book int, scan int, text string")
    got = {r["book"]: (r["anchor_scan"], r["anchor_book"], r["pages_per_scan"], r["method"]) for r in P.contents_anchors(pages).collect()}
    assert got == {1: (6, 1, 2, "front_matter_toc_heading"), 3: (12, 1, 2, "front_matter_toc_heading")}
    voted = {r["book"]: (r["anchor_scan"], r["anchor_book"]) for r in P.contents_anchors(pages, vote=True).collect()}
    assert voted[3] == (7, 9)


def test_visible_numbers_mapping(spark):
    rows = [(1, s, "\n".join(f"- {10 + 4 * (s - 3) + k} -" for k in range(4)) + "\nthe text of 1904") for s in (3, 4, 6, 7)]
    rows += [(1, 5, "２０\n2999\n二三")]  # a misread number
    rows += [(2, 1, "5\n6"), (2, 2, "7\n8")]  # too few scans
    pages = spark.createDataFrame(rows, "book int, scan int, text string")
    got = {r["book"]: tuple(r)[1:4] for r in P.visible_anchors(pages).collect()}
    assert got == {1: (3, 10, 4)}
    chosen = {r["book"]: r["method"] for r in P.inferred_mappings(pages).collect()}
    assert chosen == {1: "visible_page_number_lines"}


def test_scan_pages_go_both_ways(spark):
    scan = lambda p: value(spark, D.scan_page(F.lit(p), F.lit(12), F.lit(5), F.lit(2)))
    assert [scan(p) for p in (4, 5, 6, 7)] == [None, 12, 12, 13]
    back = lambda s: value(spark, D.book_pages(F.lit(s), F.lit(12), F.lit(5), F.lit(2)))
    assert back(11) == [] and back(12) == [5, 6] and back(14) == [9, 10]
    assert value(spark, D.page_window(F.lit(3), 2)) == [3, 2, 4, 1, 5]


def test_mapping_chain(spark):
    sources = spark.createDataFrame([(1, 1, "a", [10]), (2, 2, "a", [3, 40]), (3, 3, "b", [7]), (4, 4, "c", []), (5, 5, None, [1])], "id int, book int, source_key string, pages array<int>")
    mapping = "book int, anchor_scan int, anchor_book int, pages_per_scan int"
    inferred = spark.createDataFrame([(1, 3, 1, 4), (2, 9, 1, 2), (4, 2, 2, 3)], mapping)
    cache = spark.createDataFrame([(1, 5, 1, 2), (2, 5, 1, 2)], mapping)
    by_source = spark.createDataFrame([("b", None, 4, 4, None), ("c", 99, 8, 1, 2)], "source_key string, book int, anchor_scan int, anchor_book int, pages_per_scan int")
    failures = spark.createDataFrame([(5, "download_http_404"), (2, "timeout")], "book int, reason string")
    got = {r["id"]: r for r in P.mapped_ranges(sources, inferred, cache, by_source, failures, window=1).collect()}
    assert {k: r["origin"] for k, r in got.items()} == {1: "refined", 2: "cache", 3: "source_cache", 4: "inferred", 5: "failed"}
    assert (got[1]["start_scan"], got[1]["end_scan"], got[1]["cited_scans"]) == (5, 5, [5])
    assert (got[2]["start_scan"], got[2]["end_scan"], got[2]["cited_scans"]) == (5, 25, [6, 24])
    assert got[2]["note"] == "page_mapping_retry_after_soft_failure:timeout" and got[5]["note"] == "page_mapping_skipped_after_failure:download_http_404"
    assert got[4]["note"] == "source_level_page_mapping_cache_pid_mismatch:99!=4" and got[4]["start_scan"] is None


def test_paper_layout(spark):
    def line(page, x, y, size, text):
        return (1, page, 800.0, float(x), float(y), float(x + 50), float(y + 10), float(size), text)

    rows = [
        line(1, 72, 30, 12, "Journal 12"), line(1, 300, 101.5, 12, "went east①"), line(1, 72, 100, 12, "The party "), line(1, 72, 103, 6, "small "),
        line(1, 72, 112, 12, "and back②"), line(1, 72, 140, 12, "① again"), line(1, 72, 600, 9, "stray"), line(1, 72, 610, 9, "①Smith, p. 3"),
        line(1, 72, 620, 9, "continued"), line(1, 72, 640, 9, "② Jones"), line(1, 400, 760, 12, "17"),
        line(2, 72, 32, 12, "Journal 13"), line(2, 72, 200, 12, "No notes here"), line(2, 72, 300, 12, None),
        line(3, 72, 31, 12, "Journal 14"), line(3, 72, 580, 9, "only a small line near the foot"), line(3, 72, 700, 9, "③ unmarked"),
    ]
    lines = spark.createDataFrame(rows, "doc int, page int, height double, x0 double, y0 double, x1 double, y1 double, size double, text string").repartition(3)
    held = layout.page_rows(lines)
    first = [r["text"] for r in held.filter("page = 1").orderBy("row").collect()]
    assert first[:3] == ["Journal 12", "The party small went east①", "and back②"]
    zoned = layout.zoned_rows(held)
    assert {r["notes_from"] for r in zoned.filter("page = 1").collect()} == {608.0}
    notes = [(r["note_id"], r["mark"], r["text"]) for r in layout.page_notes(zoned).orderBy("page", "number").collect()]
    assert notes == [("p1n1", "①", "Smith, p. 3continued"), ("p1n2", "②", "Jones"), ("p3n1", "③", "unmarked")]
    pages = {r["page"]: r for r in layout.paper_pages(zoned).collect()}
    assert pages[1]["text"] == "The party small went eastand back again stray"
    assert [(n["note_id"], n["position"]) for n in pages[1]["notes"]] == [("p1n1", 25), ("p1n2", 33), ("p1n1", 34)]
    assert pages[1]["flags"] == ["pdf_page_duplicate_body_marker_reference"] and pages[2]["notes"] == []
    assert pages[3]["flags"] == ["pdf_page_footnotes_without_body_markers", "pdf_page_footnotes_exceed_body_markers"]
    heads = layout.repeated_heads(held).collect()
    assert [(r["text"], r["pages"]) for r in heads] == [("Journal #", 3)]


def plain_section(text, headings):
    ends = r"(?=\n\d+\.?\s+[A-Z]|\n[A-Z][a-z]+\s*[:：]|\nReferences|\n参考文献|$)"
    for h in headings:
        for form in (rf"{h}\s*[:：]?\s*\n(.+?)", rf"\d+\.?\s*{h}\s*[:：]?\s*\n(.+?)", rf"\n{h}\s*\n(.+?)"):
            if m := re.search(form + ends, text, re.I | re.S):
                return m.group(1).strip()[:3000]
    return ""


def test_paper_structure(spark):
    first = "\narXiv:1\nA Study of Railways in the North\nAuthor\nAbstract:\nWe study rails.\n1 Introduction\nRails matter. " + "x" * 4000
    second = "\n2. Method\nWe count.\nDiscussion: none\n结果\n增加\n参考文献\n[1] A long reference that has enough characters.\n[2] Short."
    papers = spark.createDataFrame([(1, 2, second), (1, 1, first), (2, 1, "Title\n[1] " + "r" * 600 + "\n[2] s [3] " + "t" * 40), (3, 1, None)], "doc int, page int, text string")
    got = {r["doc"]: r for r in layout.paper_structure(papers).collect()}
    assert got[1]["title"] == "A Study of Railways in the North" and got[1]["pages"] == 2
    for name, headings in layout.SECTIONS.items():
        assert got[1][name] == plain_section(first if name == "abstract" else first + "\n" + second, headings), name
    assert got[1]["references"] == ["[1] A long reference that has enough characters.\n[2] Short."]
    assert got[2]["title"] == "[2] s [3] " + "t" * 40 and [len(r) for r in got[2]["references"]] == [500, 40]
    assert got[3]["title"] == "" and got[3]["references"] == []


def test_citation_units(spark):
    text = "He wrote “the line was built in haste”①. Short。後に、満洲の鉄道は大いに発展し、人々の生活も変わった。② It was late, and it rained②b. Tail without note; then the end of all of it③"
    at = [text.index(m) for m in ("①", "②", "②b", "③")]
    long = "，".join("条" + str(k) * 12 for k in range(30)) + "。"
    rows = [
        (1, text, [("a", at[0]), ("b", at[1]), ("c", at[2]), ("d", at[3])]),
        (2, long, [("x", len(long))]),
        (3, "短い。", [("y", 3), ("z", 3)]),
        (4, None, [("n", 0)]),
        (5, "no markers here", []),
        (6, "A first thing is said here. Yes.", [("q", 32)]),
    ]
    frame = spark.createDataFrame(rows, "paragraph int, text string, notes array<struct<note_id:string,position:int>>").repartition(3)
    got = {(r["paragraph"], r["note_id"]): r for r in citation_units.citation_units(frame).collect()}
    assert len(got) == 9
    assert (got[1, "a"]["unit_type"], got[1, "a"]["text"], got[1, "a"]["confidence"]) == ("direct_quote", "the line was built in haste", 0.95)
    assert (got[1, "b"]["unit_type"], got[1, "b"]["text"]) == ("nearest_sentence", "後に、満洲の鉄道は大いに発展し、人々の生活も変わった。")
    assert got[1, "b"]["following"] == "" and got[1, "a"]["following"] == "①. Short。"
    assert got[1, "c"]["unit_type"] == "nearest_sentence" and got[1, "d"]["text"].startswith("Tail without note; then")
    assert got[1, "d"]["unit_type"] == "paragraph_span"  # the semicolon parts it into two claims
    assert got[2, "x"]["unit_type"] == "previous_clause" and 12 <= len(got[2, "x"]["text"]) <= 160
    assert got[3, "y"]["unit_type"] == "paragraph_span" and got[3, "z"]["unit_type"] == "empty" and got[4, "n"]["text"] == ""
    assert got[6, "q"]["text"] == "A first thing is said here. Yes."  # the last sentence is too short, so the whole stretch counts


def test_directory_entries(spark):
    marks = {"【生】明治": "【出生】明治", "本箱】東京": "【本籍】東京", "經歴】入社": "【經歴】入社", "家族妻": "【家族】妻", "住所大連": "【住所】大連", "【【趣味】】": "【趣味】", "a  \t b\n\n\n\nc": "a b\n\nc"}
    for bad, good in marks.items():
        assert value(spark, entries.repaired_marks(F.lit(bad))) == good
    title = lambda t, kind="タイトル本文", width=300, height=40: value(spark, entries.title_line(F.lit(t), F.lit(kind), F.lit(width), F.lit(height)))
    assert title("市場元") and title("松村勇夫") and title("市川重三郎") and title("山 田") and title("島田一二")
    assert not title("大連市") and not title("三馬路一一七") and not title("総務部") and not title("山田太郎", "本文") and title("山田太郎", "本文", 60, 160)
    lines = [(1, 1, "山田太郎", 0.9, True), (1, 2, "【出】明治【生】大正", 0.5, False), (1, 3, "【本籍】東京", 0.0, False), (1, 4, None, 0.95, False), (2, 1, "短い", None, False)]
    rows = spark.createDataFrame(lines, "entry int, ord int, text string, confidence double, is_title boolean")
    got = {r["entry"]: r for r in entries.entry_quality(rows, "entry", "ord", least_chars=10).collect()}
    assert got[1]["name"] == "山田太郎" and got[1]["marks"] == 3 and got[1]["mean_confidence"] == 0.7833 and got[1]["low_ratio"] == 0.3333
    assert got[1]["reasons"] == ["many_low_confidence_lines", "repeated_出生"]
    assert got[2]["reasons"] == ["short_entry", "few_field_markers", "missing_title_name"] and got[2]["mean_confidence"] is None


def test_reading(spark):
    assert [value(spark, summaries.reading_minutes(F.lit("x" * n))) for n in (0, 399, 400, 799, 800)] == [1, 1, 1, 1, 2]
    texts = {"": "unknown", "漢字かな": "chinese", "かなカナabcdef漢": "japanese", "漢かabcdefghijk": "other", "漢漢かかabcdefghijkl": "mixed_cjk", "plain": "other"}
    assert {t: value(spark, T.reading_language(F.lit(t))) for t in texts} == texts
    assert [value(spark, summaries.reading_difficulty(F.lit("《a》" * n))) for n in (5, 6, 11)] == ["easy", "medium", "difficult"]
    short = "一。\n二！三"
    long = "研究の一。二。三。四。五。本文の結论。七。八。"
    docs = spark.createDataFrame([(1, short), (2, long), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["summary"] for r in summaries.extractive_summary(docs).collect()}
    assert got == {1: short, 2: "研究の一 二 三 七 八", 3: ""}


def test_workflow_rules(spark):
    texts = spark.createDataFrame([(1, "他在大连创建学校，参加会议"), (2, "无")], "id int, text string")
    got = [(r["relation"], r["pattern"], r["context"]) for r in workflow.relations(texts).orderBy("id", "place").collect()]
    assert got[:3] == [("located_in", "在", "他在大连创建学校，参加会议"), ("participated_in", "参加", "他在大连创建学校，参加会议"), ("founded", "创建", "他在大连创建学校，参加会议")] and len(got) == 3
    blocks = spark.createDataFrame([(1, 2, " b \n"), (1, 1, "a"), (1, 5, " "), (1, 9, "x"), (2, 7, "y")], "page int, block int, text string")
    got = {r["page"]: r for r in workflow.page_texts(blocks, "page").collect()}
    assert (got[1]["text"], got[1]["missing"], got[1]["characters"]) == ("a\n\nb", [3, 4, 6], 4) and got[2]["text"] == "" and len(got[2]["missing"]) == 6
    assert got[1]["marked"] == "<block_1>\na\n</block_1>\n\n<block_2>\nb\n</block_2>"
    plan = spark.createDataFrame([(1, [3, 40], 5, 1, 2, 6, 26), (2, [3, 40], None, None, None, None, None), (3, [], 5, 4, 2, 5, 6)], "id int, pages array<int>, anchor_scan int, anchor_book int, pages_per_scan int, start_scan int, end_scan int")
    got = {r["id"]: r for r in workflow.download_plan(plan).collect()}
    assert (got[1]["from_page"], got[1]["to_page"], got[1]["mapped"], got[1]["note"]) == (6, 26, [6, 24], "double_page_mapping_used: book_p1->scan_p5")
    assert (got[2]["from_page"], got[2]["to_page"]) == (1, 42) and (got[3]["from_page"], got[3]["to_page"], got[3]["mapped"]) == (1, 3, [])


def test_vector_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.25 * rng.standard_normal(16)]) for k in range(900)] + [(900, [0.0] * 16), (901, None), (None, [1.0] * 16), (5, [1.0] * 16)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = chunks.filter("vec_id % 20 = 0")
    index = vector_index.build(chunks, place(spark, "index"), lists=12, sample=300)
    assert index.vectors(spark).count() == 902
    exact = batch_top_k(asked, chunks.filter("vec_id IS NOT NULL AND embedding IS NOT NULL"), 5)
    pairs = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert pairs(vector_index.search(asked, index, 5)) == pairs(exact)
    found = vector_index.search(asked, index, 5, probes=2)
    told = vector_index.recall(found, exact).first()
    assert told["queries"] == 46 and told["recall"] >= 0.9
    one = vector_index.search(asked.filter("vec_id = 20"), index, 5, probes=1)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*list#\d+ = \d+", plan) or re.search(r"PartitionFilters: \[.*list#\d+ IN", plan)
    assert 1 <= vector_index.probes_for(index, asked, 5, 0.9) <= 3
    nothing = vector_index.build(chunks.limit(0), place(spark, "index"))
    assert vector_index.search(asked, nothing, 5).count() == 0


def test_recall_of_the_registered_index(spark, sf_dir):
    from inkwright.plans.papers import QUERIES

    told = QUERIES["r03_ivf_recall"](spark, sf_dir).first()
    assert told["recall"] >= 0.9 and told["probes"] <= told["lists"]
