"""Small rows worked by hand for operators that read dates, headings, citations, replies and entities."""

import pytest
from pyspark.sql import functions as F

from inkwright.functions import dates as D
from inkwright.functions import text as X
from inkwright.operators import extraction as E
from inkwright.operators import graph as G
from inkwright.operators import records as R
from inkwright.operators import workflow as W


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, number", [("三十六", 36), ("百二", 102), ("千九百", 1900), ("一九〇三", 1903), ("廿五", 25), ("元", 1), ("十", 10), ("第三", None)])
def test_kanji_numbers(spark, text, number):
    assert value(spark, D.kanji_number(F.lit(text))) == number


def test_era_dates(spark):
    found = value(spark, D.era_dates(F.lit("明治三十六年一月一日 晴。明治36年1月2日、大正十五年十二月廿五日")))
    assert [(d["year"], d["month"], d["day"], d["era_year"]) for d in found] == [(1903, 1, 1, 36), (1903, 1, 2, 36), (1926, 12, 25, 15)]


@pytest.mark.parametrize("label, mode, pages", [("3", "single_page", 1), ("3, 7", "distributed_pages", 2), ("5-6", "continuous_range", 2), ("5-9", "range_context", 5), ("", "unmarked", 0), ("9-5", "unmarked", 0), ("1-3, 2", "distributed_pages", 3)])
def test_page_spans(spark, label, mode, pages):
    row = spark.range(1).select(D.page_list(F.lit(label)).alias("p")).select(F.size("p").alias("n"), D.page_span(F.col("p"), F.lit(label).rlike("[,，、;；]"), F.lit(0), F.lit(""), F.lit(label).contains("-")).alias("m")).first()
    assert (row["m"], row["n"]) == (mode, pages)


def test_citations_and_quotes(spark):
    citation = 'Smith, John. "Tokugawa Reforms." Journal of Japanese History, 2012, vol. 12, no. 3, pp. 45-67. https://doi.org/10.1234/abcd'
    row = spark.range(1).select(E.citation_fields(F.lit(citation)).alias("f")).select("f.*", E.citation_confidence(F.col("f")).alias("c"), E.citation_style(F.lit(citation)).alias("s")).first()
    assert tuple(row) == ("Tokugawa Reforms", "2012", "12", "3", "45-67", "10.1234/abcd", "https://doi.org/10.1234/abcd", 0.95, "chicago")
    assert set(value(spark, E.quotes(F.lit("彼は「制度維持の手順」と「短い」と述べ “a long English quote” とした")))) == {"制度維持の手順", "a long English quote"}


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "preface\n# Introduction\none\n## Part\ntwo\n## Other\n### Deep\nx\n# Conclusion\nend")], "doc_id long, text string")
    got = [(r["section"], r["level"], r["title"], r["parent"]) for r in E.heading_parents(E.headings(docs)).orderBy("section").collect()]
    assert got == [(0, 0, "Document Start", None), (1, 1, "Introduction", None), (2, 2, "Part", 1), (3, 2, "Other", 1), (4, 3, "Deep", 3), (5, 1, "Conclusion", None)]
    assert [tuple(x) for x in value(spark, X.links(F.lit("see [home](https://example.com) now")))] == [("home", "https://example.com")]
    assert [tuple(x) for x in value(spark, X.code_blocks(F.lit("text\n```python\na = 1\nb = 2\n```\nend")))] == [(0, "python", 2, "a = 1\nb = 2\n```")]


def test_entities_keep_all_their_categories(spark):
    docs = spark.createDataFrame([(1, "Edo and Edo castle"), (2, None), (3, "")], "doc_id long, text string")
    known = spark.createDataFrame([("Edo", "place"), ("Edo", "era"), ("Edo", "place"), ("Edo castle", "place"), ("", "none"), ("castle", None)], "entity string, category string").repartition(3)
    got = sorted((r["doc_id"], r["start"], r["entity"], str(r["category"])) for r in E.dictionary_entities(docs, known).collect())
    assert got == [(1, 0, "Edo", "era"), (1, 0, "Edo", "place"), (1, 8, "Edo", "era"), (1, 8, "Edo", "place"), (1, 8, "Edo castle", "place"), (1, 12, "castle", "None")]


def test_disambiguation(spark):
    rules = spark.createDataFrame([("江户", 1, "东京", "place", ["城市"], ["都市"]), ("江户", 2, "德川幕府", "organization", ["幕府", "将军"], ["统治"])], "entity string, rule_order int, standard_name string, category string, patterns array<string>, keywords array<string>")
    rows = spark.createDataFrame([("江户", "江户幕府 将军 统治"), ("Unknown Entity", "")], "entity string, context string")
    got = {r["entity"]: (r["standard_name"], r["score"], r["known"]) for r in E.disambiguated(rows, rules).collect()}
    assert got == {"江户": ("德川幕府", 0.8, True), "Unknown Entity": ("Unknown Entity", 0.0, False)}


def plain_edges(docs):
    import re

    out = set()
    for a, _, text in docs:
        for b, title, _ in docs:
            words = [w.lower() for w in re.findall("[A-Za-z一-鿿]{4,}", title)]
            n = sum(w in (text or "").lower() for w in words)
            if a != b and n >= 2:
                out.add((a, b, round(min(0.9, 0.4 + 0.15 * n), 4)))
    return out


def test_citation_edges(spark):
    import random

    rng = random.Random(8)
    words = ["station", "nation", "rational", "relation", "governance", "reform", "study", "满洲铁道研究", "铁道研究", "of", "the", "Reforms", "Station"]
    docs = [(f"d{k}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([None, ""]) if k % 13 == 0 else " ".join(rng.choice(words) + rng.choice(["", "s", "al"]) for _ in range(rng.randint(0, 12)))) for k in range(40)]
    docs += [("doc_a", "Meiji Political Thought", "It builds on Tokugawa Governance Reform of 2001."), ("doc_b", "Tokugawa Governance Reform", "An older study.")]
    frame = spark.createDataFrame(docs, "id string, title string, text string")
    got = {(r["source"], r["target"], round(r["confidence"], 4)) for r in G.citation_edges(frame).collect()}
    assert got == plain_edges(docs) and ("doc_a", "doc_b", 0.85) in got


def test_replies_and_records(spark):
    assert tuple(value(spark, R.first_json(F.lit('Reply: ```json\n{"best_index": 1, "confidence": 0.88}\n``` done'), "best_index int, confidence double"))) == (1, 0.88)
    assert tuple(value(spark, R.first_json(F.lit('note {x} and {"a": 1, "b": "x"} {"a": 2}'), "a int, b string"))) == (1, "x")
    seen = [(1, s, n) for s, ns in {1: (10, 11), 2: (12, 13), 4: (16, 17), 5: (18, 19), 6: (60, 61)}.items() for n in ns]
    assert [tuple(r) for r in R.pages_per_scan(spark.createDataFrame(seen, "book int, scan int, number int"), "book").collect()] == [(1, 2)]
    notes = spark.createDataFrame([(1, 0, "満洲国史", ["满洲国史"]), (1, 1, "满洲国史", []), (1, 2, "other", ["满洲国史"])], "doc_id int, ordinal int, title string, defines array<string>")
    assert [r["resolved_title"] for r in R.aliased_titles(notes).orderBy("ordinal").collect()] == ["満洲国史", "満洲国史", "other"]
    rows = [(1, "江户", "place", 0, 2, 0.5, True), (2, "江户", "place", 0, 2, 0.9, False), (3, "江户", "place", 0, 2, 0.6, True), (4, "Edo", "place", 5, 8, 0.7, False)]
    merged = W.merged_entities(spark.createDataFrame(rows, "ord int, text string, category string, start int, stop int, confidence double, needs_review boolean")).collect()
    assert sorted((r["text"], r["confidence"], r["needs_review"]) for r in merged) == [("Edo", 0.7, False), ("江户", 0.9, True)]
    assert value(spark, W.cleaned_ocr(F.lit("本文　　一行 \n - 12 - \n 次の行\x07"))) == "本文 一行\n次の行"


def test_era_variants_and_source_dates(spark):
    from inkwright.operators import citations as C

    got = value(spark, D.era_variants(F.lit("1912年3月05日 and 1926年、2019年1月 and 1700年")))
    assert got == ["明治45年3月5日", "明治四十五年3月5日", "大正元年3月5日", "大正1年3月5日", "大正一年3月5日", "大正15年", "大正十五年", "昭和元年", "昭和1年", "昭和一年", "平成31年1月", "平成三十一年1月", "令和元年1月", "令和1年1月", "令和一年1月"]
    assert value(spark, D.source_dates(F.lit("1904年3月5日 明治三十七年3月 1904年"))) == ["1904年3月5日", "明治三十七年3月 19", "1904年"]
    none = F.lit(None).cast("string")
    assert value(spark, C.rendered_book("gb7714", F.lit("史"), none, none, none, none, none, F.lit(3))) == "[3] 未知作者. 史 [M]. 未知出版社, n.d.."


def test_evidence_is_counted_in_values_alone(spark):
    replies = ['{"evidence_text": "a", "b": [{"evidence_text": ""}, {"evidence_text": ["x"], "c": {"evidence_text": 1}}]}', '{"t": "\\"evidence_text\\": \\"no\\""}', "no json", None, "[[{\"evidence_text\": true}]]"]
    rows = spark.createDataFrame(list(enumerate(replies)), "id int, t string")
    assert [r["n"] for r in rows.orderBy("id").select(E.evidence_count("t").alias("n")).collect()] == [3, 0, 0, 0, 1]
