"""Styles, confidences, payloads, tables, lists and merged records on rows worked by hand."""

from pyspark.sql import functions as F

from inkwright.operators import packages, summaries


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_styles_and_tone(spark):
    style = lambda t: value(spark, packages.detected_style(F.lit(t).cast("string")))
    assert [style(t) for t in (None, "", "[3] x [J], no. 4", '[3] y vol. 1, No. 2', 'A. "T." 1990')] == ["unknown", "unknown", "gb7714", "ieee", "chicago"]
    tone = value(spark, packages.tone(F.lit("I argue. I argue. research shows however, however")))
    assert tuple(tone) == ("subjective", "critical", 2, 1)
    assert tuple(value(spark, packages.rhetoric(F.lit("Therefore, in Contrast; FIRST, 因此"))))[:2] == ("comparison-heavy", "deductive")


def test_confidences(spark):
    flags = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert value(spark, packages.disambiguation_confidence(F.lit(2), F.lit(0.2), flags("empty_context", "unknown_entity_rules"))) == 0.0
    assert value(spark, packages.biography_confidence(F.lit(0), flags(*"abcdef"))) == 0.1
    assert value(spark, packages.recognition_confidence(F.lit(True), F.lit(0), F.lit(0), flags())) == 0.76
    assert value(spark, packages.embedding_confidence(F.lit(True), F.lit(False), F.lit(0), flags("empty_documents", "empty_query", "mock_embedding_used"))) == 0.25


def test_review_payloads(spark):
    def read(sentences, **fields):
        names = ("decision", "best_index", "confidence", "exact_sentence", "reason")
        reply = F.struct(*[F.lit(fields.get(n)).cast("string").alias(n) for n in names])
        return tuple(value(spark, packages.review_payload(reply, F.array(*map(F.lit, sentences)).cast("array<string>"))))

    assert read(["one two", "three"], decision="direct_support", best_index="1", exact_sentence="two", confidence="0.9") == ("direct_support", 1, "two", 0.9, "")
    assert read(["one two"], decision="direct_support", exact_sentence=" own  words ") == ("direct_support", 0, "own words", 0.0, "")
    assert read([], decision="direct_support", best_index="1") == ("uncertain", 0, "", 0.0, "") and read([], decision=None, reason=" a\nb ") == ("uncertain", 0, "", 0.0, "a b")


def test_tables_and_lists(spark):
    docs = spark.createDataFrame([(1, "a\tb\nc\td\te\nplain\nx,,y\n\nz，，w"), (2, None), (3, "one")], "doc_id int, text string")
    got = [(r["doc_id"], r["table"], r["row"], r["cells"]) for r in packages.text_tables(docs).orderBy("doc_id", "table", "row").collect()]
    assert got == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["c", "d", "e"]), (1, 1, 0, ["x", "y"]), (1, 2, 0, ["z", "w"])]
    docs = spark.createDataFrame([(1, "• a\n1. b\nno\nA. c\n* d"), (2, "")], "doc_id int, text string")
    got = [(r["list"], r["item"], r["kind"]) for r in packages.text_lists(docs).orderBy("list", "row").collect()]
    assert got == [(0, "a", "bullet"), (0, "b", "bullet"), (1, "c", "ordered"), (1, "d", "ordered")]


def test_merged_records(spark):
    schema = "query int, list int, ordinal int, title string, source_id string, url string, author string, date string, publisher string, pdf_url string, route string, hints array<struct<snippet:string,pdf_page:int>>"
    hint = lambda *x: [{"snippet": s, "pdf_page": p} for s, p in x]
    rows = [(1, 0, 0, "T", "a", "", None, "1990", "", "", "r1", hint(("s", 1))), (1, 1, 0, "U", "a", "u", "X", "1991", "", "p", "r2", hint(("s", 1), ("t", None))), (1, 1, 1, "T", None, " ", "", "", "", "", None, None), (1, 1, 2, "", "", "", "q", "", "", "", "r1", None), (1, 1, 3, "", "", "", "z", "", "", "", "r1", None)]
    got = [(r["rank"], r["title"], r["source_id"], r["url"], r["author"], r["date"], r["routes"], len(r["hints"])) for r in packages.merged_records(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]
    assert got == [(1, "T", "a", "u", "X", "1990", ["r1", "r2"], 2), (2, "T", "", " ", "", "", [], 0), (3, "", "", "", "q", "", ["r1"], 0), (4, "", "", "", "z", "", ["r1"], 0)]


def test_outline_leaves_references_out(spark):
    rows = spark.createDataFrame([(1, 0, "Body", "w " * 50), (1, 1, "References", "r")], "doc_id int, section int, title string, content string")
    got = {(r["issue"], r["section"]) for r in summaries.outline_issues(summaries.outline_ratios(rows), ["body"]).collect()}
    assert got == {("section_too_long", "Body"), ("length_warning", None)}
