"""Page furniture, regions, hints, facets and support on rows worked by hand, and against plain versions."""

import random
import re

from pyspark.sql import functions as F

from inkwright.operators import graph, retrieval, screening


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


ONES = dict(zip("一二三四五六七八九", range(1, 10)))


def plain_numeral(token):
    token = token.strip()
    if token in ONES or token in ("十", "百"):
        return ONES.get(token) or {"十": 10, "百": 100}[token]
    if m := re.match("([一二三四五六七八九])?十([一二三四五六七八九])?", token):
        return (ONES[m[1]] if m[1] else 1) * 10 + (ONES[m[2]] if m[2] else 0)
    return int(token) if token.isdigit() else None


def plain_furniture(text):
    lines = (text or "").strip().split("\n")
    tried = [(p, i) for p in screening.PAGE_NUMBERS for i in range(len(lines) - 1, max(-1, len(lines) - 5), -1)] + [(p, i) for i in range(len(lines)) for p in screening.PAGE_NUMBERS]
    number, rest = None, text or ""
    for p, i in tried:
        if (m := re.search(p, lines[i].strip())) and (n := plain_numeral(m[1])) is not None:
            number, rest = n, "\n".join(lines[:i] + lines[i + 1 :])
            break
    lines = rest.strip().split("\n")
    looks = lambda x: re.match(screening.HEADERS, x.strip())
    head = next((i for i, x in enumerate(lines[:3]) if looks(x)), None)
    begin = 0 if head is None else head + 1
    foot = next((i for i in range(len(lines) - 1, max(begin, len(lines) - 4), -1) if lines[i].strip() and len(lines[i].strip()) < 50 and looks(lines[i])), None)
    return number, lines[head].strip() if head is not None else "", lines[foot].strip() if foot is not None else "", "\n".join(lines[begin:foot])


def test_page_furniture(spark):
    rng = random.Random(4)
    bits = ["第三章 題", "二、節", "本文である", "- 12 -", "二十三", "百", "百二", "—七—", "x 45", "", "  ", "第二編", "5 apples", "五十", "　三　"]
    texts = [None, "", "\n\n", "12"] + ["\n".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: tuple(r)[2:] for r in screening.page_furniture(pages).collect()}
    for k, text in enumerate(texts):
        assert got[k] == plain_furniture(text), (text, got[k])


def test_regions(spark):
    region = lambda t, top=500, bottom=600: value(spark, screening.region_class(F.lit(t), F.lit(top), F.lit(bottom), F.lit(1000)))
    assert [region(""), region("序", 50), region("x" * 60, 50), region("x", 950, 990), region("明治三年一月二日"), region("目次"), region("章" + "x" * 40)] == ["unknown", "header", "body_text", "footer", "date", "title", "body_text"]
    content = lambda t: value(spark, screening.content_class(F.lit(t)))
    assert [content(""), content("昭和二年"), content("晴れ"), content("晴れた日の長い文章である"), content("彼は「はい」と言った")] == ["unknown", "date", "weather", "handwritten", "quote"]


def test_support(spark):
    def support(decision=None, exact=None, reason=None, matched="text", confidence=0.7, distance=None, scope="cited_pages", notes=""):
        lits = [F.lit(x).cast(t) for x, t in ((decision, "string"), (exact, "string"), (reason, "string"), (matched, "string"), (confidence, "double"), (distance, "int"), (scope, "string"), (notes, "string"))]
        return tuple(value(spark, screening.support_assessment(*lits)))

    assert support() == ("direct_support", "matched") and support(confidence=0.59)[0] == "partial_support"
    assert support("direct_support", "s", distance=2) == ("page_mismatch_but_support", "matched") and support("direct_support", " ", confidence=0.1)[0] == "needs_manual_review"
    assert support("uncertain")[0] == "direct_support" and support("uncertain", reason="r")[0] == "needs_manual_review" and support("not_supported")[0] == "not_supported"
    assert support(matched=None, notes="LLM_rejected")[0] == "not_supported" and support(matched="")[0] == "needs_manual_review"
    assert support(distance=2)[0] == "page_mismatch_but_support" and support(distance=2, notes="llm_alignment_failed: x")[0] == "partial_support"
    assert support(scope=None)[0] == "partial_support" and support(notes="Heuristic_alignment_used")[0] == "partial_support" and support(confidence=None)[0] == "needs_manual_review"


def test_hints_and_facets(spark):
    works = spark.createDataFrame([("a", 1, "Letters home", None), ("a", 2, None, "archival letters; CENSUS"), ("a", 3, "", ""), ("b", 1, None, None)] + [("c", k, "Hansard" if k == 16 else "x", "") for k in range(1, 18)], "key string, ord int, title string, abstract string")
    assert {r["key"]: r["hints"] for r in screening.source_hints(works, "key", "ord").collect()} == {"a": ["correspondence", "archive", "statistical"], "b": [], "c": []}
    rows = [(1, "person", 0, "後藤新平"), (1, "date", 0, "三月五日"), (1, "theme", 0, "（注）満鉄調査"), (2, "person", 0, "後藤新平"), (3, "theme", 0, "ab"), (3, "policy", 0, "委任統治")] + [(4, b, k, f"用語{b}{k}") for b in ("theme", "policy") for k in range(10)]
    got = {}
    for r in screening.generic_facets(spark.createDataFrame(rows, "id int, bucket string, ordinal int, term string")).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["facet_id"], r["required"], len(r["terms"])))
    assert got == {1: [("bucket_theme", True, 1), ("bucket_person", True, 1), ("bucket_date", False, 1)], 4: [("bucket_policy", True, 8), ("bucket_theme", True, 8)]}


def test_leads_and_snippets(spark):
    hints = [(1, 0, "wrong_pid", True, True, 9.0, True, True, None), (1, 1, "body_candidate", False, True, 1.0, None, True, "s"), (1, 2, "body_candidate", True, False, 0.5, False, False, "s"), (1, 3, "strange", True, True, 9.0, True, True, ""), (1, 4, "body_candidate", None, True, 1.0, True, None, "s"), (1, 5, "body_candidate", True, True, 9.0, True, True, "t")]
    frame = spark.createDataFrame(hints, "key int, ordinal int, category string, has_claim boolean, is_specific boolean, specificity double, has_context boolean, has_page boolean, source_id string").withColumn("wanted", F.lit("s"))
    ranks = lambda df: [r["ordinal"] for r in df.orderBy("rank").collect()]
    assert ranks(screening.ordered_leads(frame, "key", "wanted")) == [2, 4, 1, 0, 3] and ranks(screening.ordered_leads(frame, "key")) == [5, 2, 4, 1, 0, 3]
    match = lambda *m: [{"head": h, "word": w, "tail": t} for h, w, t in m]
    contents = [("p", 0, "c1", 4, match(("a ", "b", " c"), ("a", " b ", "c"))), ("p", 1, "c2", None, match((None, " ", None), ("new", "", None))), ("p", 2, "c1", 7, match(("a b", " ", "c"))), ("q", 0, None, 1, match(("x", "y", "z")))]
    schema = "pid string, ordinal int, cid string, index int, matches array<struct<head:string,word:string,tail:string>>"
    records, known = spark.createDataFrame([("p",), ("p",)], "pid string"), spark.createDataFrame([("p", "new", None)], "pid string, snippet string, pdf_page int")
    maps = spark.createDataFrame([("p", "c1", 50)], "pid string, cid string, page int")
    got = [tuple(r) for r in screening.merged_snippets(records, known, spark.createDataFrame(contents, schema), maps).orderBy("ordinal").collect()]
    assert got == [("p", 0, "a b c", 50, "c1")]


def test_answers_and_networks(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "one " * 100, "a"), (2, [0.8, 0.6], "two", None), (3, [0.0, 1.0], None, "c"), (4, [-1.0, 0.0], "four", "d")], "vec_id long, embedding array<float>, text string, source string")
    row = retrieval.answered(chunks.filter("vec_id = 1"), chunks, 3).first()
    assert row["sources"] == [1, 2, 3] and abs(row["confidence"] - 0.6) < 1e-6
    assert row["answer"] == "[a] " + ("one " * 100)[:300] + "\n\n[] two\n\n[c] " and row["context"].startswith("one one")
    docs = spark.createDataFrame([("a", "Tokugawa Governance", "1990", "x"), ("b", "Other", "1991", "on tokugawa governance"), ("c", "Third", None, None), ("d", "Fourth", "1992", "tokugawa governance")], "id string, title string, year string, text string")
    nodes, edges, told = graph.citation_network(docs, most=1)
    assert [(r["source"], r["target"]) for r in edges.collect()] == [("b", "a")]
    assert told.first()["edges"] == 2 and not told.first()["sparse"] and [r["id"] for r in nodes.filter("is_core").collect()] == ["a"]
    assert graph.citation_network(docs.withColumn("text", F.lit("")))[2].first()["sparse"]
