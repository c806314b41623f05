"""Operators on small inputs worked out by hand."""

import pytest
from pyspark.sql import functions as F

from inkwright.functions import dates, text
from inkwright.operators import dedup, evidence, extraction, graph, retrieval, runs
from inkwright.sources import readers, writers


def value(spark, column, **row):
    frame = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


def test_cosine_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    best = retrieval.top_k(rows, [1, 0.2, 0], 4).collect()
    assert [r["vec_id"] for r in best] == [1, 2, 3, 4]
    assert best[0]["score"] == pytest.approx(0.980581, abs=1e-6) and best[1]["score"] == pytest.approx(0.832050, abs=1e-6) and best[3]["score"] == 0
    many = retrieval.batch_top_k(rows.filter("vec_id = 2"), rows, 2).collect()
    assert [(r["vec_id"], r["rank"]) for r in sorted(many, key=lambda r: r["rank"])] == [(2, 1), (1, 2)]
    assert retrieval.batch_top_k(rows.limit(0), rows, 2).count() == 0


def test_filter_before_or_after_the_cut(spark):
    rows = spark.createDataFrame([(k, [1.0, k / 10], k % 2) for k in range(6)], "vec_id int, embedding array<float>, label int")
    before = retrieval.top_k(rows, [1.0, 0.0], 2, where=F.col("label") == 1)
    after = retrieval.top_k(rows, [1.0, 0.0], 2, where=F.col("label") == 1, post_filter=True)
    assert [r["vec_id"] for r in before.collect()] == [1, 3] and [r["vec_id"] for r in after.collect()] == [1]


def test_keyword_repeats_count(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id int, text string")
    once = {r["doc_id"]: r["score"] for r in retrieval.keyword_scores(docs, "a").collect()}
    twice = {r["doc_id"]: r["score"] for r in retrieval.keyword_scores(docs, "a a").collect()}
    assert twice[1] == pytest.approx(2 * once[1]) and once[2] == once[3] == 0


def test_hash_vector_is_stable(spark):
    a, b = (value(spark, retrieval.hash_vector(F.lit(t), 8)) for t in ("x", "x"))
    assert a == b and sum(x * x for x in a) == pytest.approx(1)


def test_windows_rebuild_the_text(spark):
    body = "seven__" * 100
    parts = value(spark, text.fixed_windows(F.lit(body), 100, 20))
    assert "".join(p["text"][: 80 if p["index"] < len(parts) - 1 else None] for p in parts).startswith(body)
    with pytest.raises(ValueError):
        text.fixed_windows(F.lit(body), 10, 10)


def test_sentences_and_tokens(spark):
    assert value(spark, text.sentences(F.lit("One. Two！\n三。 rest"))) == ["One.", "Two！", "三。", "rest"]
    assert value(spark, text.tokens(F.lit("Abc 12漢字, x"))) == ["abc", "12", "漢字", "x"]
    assert value(spark, text.token_estimate(F.lit("漢字abcd"))) == 3
    assert value(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(spark, text.truncated(F.lit("a  b " * 10), 5)) == "a b a..."
    assert value(spark, text.wiki_links(F.lit("[[A|x]] [[B]] [[A]]"))) == ["A", "B"]


def test_numbers_and_eras(spark):
    for n in (1, 10, 11, 99, 105, 1900, 9999):
        assert value(spark, dates.kanji_number(dates.to_kanji(F.lit(n)))) == n
    assert value(spark, dates.era_year(F.lit("昭和"), F.lit(5))) == 1930
    assert value(spark, dates.page_list(F.lit("3, 5-7; 6"))) == [3, 5, 6, 7]


def test_dedup_is_independent_of_input_order(spark):
    rows = [("a", 2, "x"), ("A ", 1, "y"), ("b", 3, "z"), ("a", 2, "w")]
    frame = lambda r: spark.createDataFrame(r, "name string, conf int, ord string")
    want = {("a", "w"), ("b", "z")}
    for order in (rows, rows[::-1]):
        assert {(r["name"], r["ord"]) for r in dedup.keep_best(frame(order), "name", "conf", ["ord"]).collect()} == want


def test_core_flags_follow_degree_then_year(spark):
    nodes = spark.createDataFrame([(k, f"t{k}", str(1990 + k)) for k in range(10)], "id int, title string, year string")
    edges = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, 7)], "source int, target int")
    out = graph.with_core(graph.degrees(nodes, edges)).filter("is_core").collect()
    assert {r["id"] for r in out} == {5, 7}


def test_pairs_ignore_unmatched_and_restarts(spark):
    rows = [("k", "start", 1), ("k", "start", 5), ("k", "end", 9), ("k", "end", 11), ("j", "end", 3)]
    frame = spark.createDataFrame(rows, "key string, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    pairs = runs.paired_events(frame, ["key"], ["ts"], "kind", "ts", "start", "end").collect()
    assert [(r["key"], r["seconds"]) for r in pairs] == [("k", 4.0)]


def test_change_points_skip_blanks(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "", "a", "b", None, "b"])], "doc int, page int, header string")
    assert [r["is_new"] for r in runs.change_points(rows, "doc", ["page"], "header").orderBy("page").collect()] == [True, False, False, True, False, False]


def test_similarity(spark):
    assert value(spark, evidence.text_similarity(F.lit("Ａbc (x)"), F.lit("abc"))) == 1.0
    assert value(spark, evidence.text_similarity(F.lit(""), F.lit("abc"))) is None


def test_overlapping_entities(spark):
    docs = spark.createDataFrame([(1, "aabaab")], "doc_id int, text string")
    words = spark.createDataFrame([("aab", "x"), ("ab", "y")], "entity string, category string")
    found = {(r["entity"], r["start"]) for r in extraction.dictionary_entities(docs, words).collect()}
    assert found == {("aab", 0), ("ab", 1), ("aab", 3), ("ab", 4)}


def test_catalogue_records(spark):
    xml = "<records><record><title>A</title><date>1903</date></record><record><title>B</title><creator>C</creator></record></records>"
    rows = readers.catalogue_records(spark.createDataFrame([(xml,)], "xml string")).orderBy("rank").collect()
    assert [(r["rank"], r["title"], r["creator"], r["date"]) for r in rows] == [(1, "A", None, "1903"), (2, "B", "C", None)]


def test_manifest_stays_inside_the_root(spark):
    rows = spark.createDataFrame([("/r/a",), ("/r/../x",), ("/q/a",), ("/r/secrets/k",)], "path string")
    assert [r["path"] for r in writers.artifact_manifest(rows, "/r").collect()] == ["/r/a"]


def test_recursive_chunks_choose_one_separator():
    from inkwright.operators.splitting import recursive_chunks, sentence_chunks

    body = "aaaa bbbb\ncccc dddd\neeee"
    assert [body[a:b] for a, b, _ in recursive_chunks(body, 10, 0)] == ["aaaa bbbb", "cccc dddd", "eeee"]
    assert [o for _, _, o in recursive_chunks(body, 10, 3)] == ["", "bbb", "ddd"]
    assert len(recursive_chunks("x" * 100, 40, 10)) == 4 and recursive_chunks("  ") == []
    assert [b - a for a, b, _ in sentence_chunks("One is here. " * 20, 60, 1, 30)][:2] == [51, 52]


def test_same_place_tolerates_nulls(spark):
    from inkwright.operators.records import same_place

    rows = spark.createDataFrame([("a", 1, "a", None), ("a", 1, "b", 1), (None, None, "b", 1)], "c string, p int, d string, q int")
    assert [r["v"] for r in rows.select(same_place(F.col("c"), F.col("p"), F.col("d"), F.col("q")).alias("v")).collect()] == [True, False, True]
