"""Steps whose time or memory once grew faster than their input, on small inputs that show it."""

import re
import time

from pyspark.sql import functions as F

from inkwright.operators import citations, claims, facets, graph, narratives, page_mapping, records


def test_speeches_of_a_long_line(spark):
    """One line of 150,000 characters, whose only ending is in its middle, and a run of names before speeches."""
    line = "x" * 75_000 + "と申候" + "y" * 75_000
    text = line + "\n" + "\n".join(f"{'z' * 60}曰「{k}」" for k in range(50))
    began = time.time()
    got = narratives.speeches(spark.createDataFrame([(1, text)], "id int, text string"), "id").collect()
    assert time.time() - began < 30
    kinds = [r["kind"] for r in got]
    assert kinds.count("正式陈述") == 1 and kinds.count("古文陈述") == 1 and kinds.count("直接引语") == 100
    assert {r["speaker"] for r in got} == {""} and [r["start"] for r in got if r["kind"] == "正式陈述"] == [0]
    for pattern in (r"(.+?)候", r"(.+?)と申候", r"「(.+?)」"):
        for short in ("候", "候候", "a候候b候\n候\n\nと申候", "xと申候と申候y\nと", "「」「a」"):
            assert [m.span() for m in narratives._matches(pattern, short)] == [m.span() for m in re.finditer(pattern, short)]


def test_lists_of_facet_queries_are_computed_once(spark):
    assert len(str(facets.facet_queries(F.col("f"), F.col("d")))) < 4_000  # 5,437 with each list spelled out where it is used


def test_a_listed_page_is_looked_up_once(spark):
    assert len(str(page_mapping._listed_page(F.col("a"), F.col("b")))) < 3_000  # 4,559 with the heading's form spelled out where it is used
    rows = spark.createDataFrame([("第一章海 十二 第一章海路 三", "第一章海路"), ("第一章海", "第一章海路"), ("序", "緒論")], "a string, b string")
    assert [r[0] for r in rows.select(page_mapping._listed_page(F.col("a"), F.col("b"))).collect()] == [3, None, None]


def test_best_window_of_a_long_text(spark):
    text = "ab th " * 20_000 + "th " * 70 + "cd " * 300 + "😀" * 300
    began = time.time()
    rows = spark.createDataFrame([(text,), ("th" * 100,), (None,), ("q" * 261,)], "t string")
    score = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("th"), F.lit("")))) / F.length(t)
    got = [r[0] for r in rows.select(claims.best_window(F.col("t"), score)).collect()]
    assert time.time() - began < 20
    t = text.strip()
    windows = [t[k : k + 220] for k in range(0, len(t) - 219, 60)]
    best = max(windows, key=lambda w: (len(w) - len(w.replace("th", ""))) / len(w))
    assert got == [best, "th" * 100, None, "q" * 261]


def test_best_window_after_a_scan_number(spark):
    """All of a text counts, also what stands behind a number like those of scans."""
    score = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("th"), F.lit("")))) / F.length(t)
    long = "ab " * 100 + "E1234567 " + "cd " * 97 + "th " * 100
    rows = spark.createDataFrame([("E123456 th",), ("xE00000000",), (long,)], "t string")
    got = [r[0] for r in rows.select(claims.best_window(F.col("t"), score)).collect()]
    assert got == ["E123456 th", "xE00000000", long[600:820]]


def test_best_windows_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Repeated rows, no ids, wide spaces and scan numbers."""
    import duckdb

    from inkwright.plans.curation import QUERIES, SQL

    long = "ab " * 100 + "E1234567 " + "cd " * 97 + "th " * 100
    texts = [(1, "a th"), (1, "a  th "), (1, "b"), (None, "x"), (None, "x"), (2, "\u00a0\u3000"), (3, "\u2003q\u2003 "), (4, " "), (5, None), (6, "\n\t"), (7, long), (7, "\n" + long), (8, long + "é😀" * 200), (9, "q\u2003" * 300), (10, "x" * 260), (11, "y" * 261)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["w15_best_window"]).fetchall()
    got = [tuple(r) for r in QUERIES["w15_best_window"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_active_facets_of_a_long_claim_and_short_triggers(spark):
    claims_ = spark.createDataFrame([(1, "ab " * 60_000 + "zed"), (2, "q"), (3, None), (4, "b😀q")], "id int, claim string")
    rules = spark.createDataFrame([("one", ["q"], ["t"]), ("end", ["zed", "b😀"], ["u", "v"]), ("any", [""], ["w"]), ("none", ["zz"], ["x"])], "bucket string, triggers array<string>, terms array<string>")
    began = time.time()
    got = {(r["id"], r["bucket"]): r["terms"] for r in records.active_facets(claims_, rules).collect()}
    assert time.time() - began < 20
    assert got == {(1, "end"): ["u", "v"], (1, "any"): ["w"], (2, "one"): ["t"], (2, "any"): ["w"], (4, "one"): ["t"], (4, "end"): ["u", "v"], (4, "any"): ["w"]}


def test_citation_edges_by_whole_words(spark):
    docs = spark.createDataFrame([(1, "Study of Studying 満州鉄道", None), (2, "no title", "understudying 南満州鉄道の"), (3, "Study study", "x"), (4, None, "study")], "id int, title string, text string")
    got = {(r["source"], r["target"]): round(r["confidence"], 2) for r in graph.citation_edges(docs).collect()}
    assert got == {(2, 1): 0.85, (2, 3): 0.7, (4, 3): 0.7}
    # Texts and titles that share all their parts but no word make no pairs to be checked.
    names = ["".join(chr(97 + int(d)) for d in f"{k:05d}") for k in range(3_000)]
    many = spark.createDataFrame([(k, f"topic{n}z", f"retopic{n}y") for k, n in enumerate(names)], "id int, title string, text string")
    assert graph.citation_edges(many).count() == 0


def test_mention_edges_to_documents_of_several_titles(spark):
    docs = spark.createDataFrame([(1, "A"), (1, "B"), (2, "a"), (2, "A"), (3, ""), (3, None), (4, "b")], "id int, title string")
    found = spark.createDataFrame([(2, "a", 0.5), (2, "B", 0.9), (4, "A", None), (4, "a", 0.6), (1, "b", 0.2), (9, "", 0.9)], "id int, title string, confidence double")
    edges = citations.mention_edges(docs, found)
    assert sorted(edges.collect()) == [(1, 4, 0.55), (2, 1, 0.9), (2, 4, 0.9), (4, 1, 0.6), (4, 2, 0.6)]


def test_alignment_sends_no_table_to_the_driver(spark, sf_dir):
    """Claims or segments were taken for small by the files they come from, and gathered on the driver."""
    from inkwright.plans.papers import QUERIES

    found = QUERIES["r25_alignment"](spark, sf_dir)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(found.collect()) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_page_priority_reads_its_tables_a_few_times(spark, sf_dir):
    """Every scope by joins of its own read the orders 54 times and sent 30 tables to the driver."""
    from inkwright.plans.papers import QUERIES

    plan = QUERIES["r26_page_priority"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 6 and plan.count("BroadcastExchange") <= 4


def test_only_segments_that_can_win_are_compared_in_full(spark):
    """Of 40 segments without a common character and one that holds the claim, one is left for the ratio; all that are equal stay."""
    from inkwright.operators import evidence

    claim = "満洲鉄道の調査"
    rows = spark.createDataFrame([(k, claim, f"天気は晴れで海は静か {k}" if k else claim + "である") for k in range(41)] + [(99, claim, claim + "である")], "id int, claim string, segment string").withColumn("c", F.lit(1))
    sides = evidence._sides(evidence._sides(rows, "claim", "a"), "segment", "b")
    got = {r["id"]: r["score"] for r in evidence._scored(sides, "claim", "segment", {}, ["c"]).collect()}
    assert set(got) == {0, 99} and abs(got[0] - (0.2 * 14 / 17 + 0.35 + 0.25)) < 1e-9


def test_ratios_by_parts_that_both_share():
    import random
    from difflib import SequenceMatcher

    from inkwright.operators.evidence import _ratio

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd鉄道") for _ in range(rng.choice((0, 1, 5, 30, 250)))) for _ in range(2))
        for x, y in ((a, b), (a, a[3:] + b), (a + b, b), (a, a)):
            assert _ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_claims_clean_a_text_once(spark):
    """Parts of a cleaned text need no cleaning of their own: one pattern of spaces, where each part and group had one."""
    import inspect

    text = "  多く の文、　短い 部分。\x0b and a part , of  it;\n\nmore！ " * 3
    for f in (claims.claims, claims.page_claims, claims.review_sentences):
        got = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("c")).collect()[0]["c"]
        assert got and all(c == re.sub(r"[\s 　]+", " ", c).strip(" ") for c in got)
    assert "collapse" not in inspect.getsource(claims._pieces)
    assert str(claims.page_claims(F.col("t"))).count("regexp_replace") == 1


def test_word_frequencies_without_a_join(spark):
    from inkwright.operators import summaries

    rows = spark.createDataFrame([(1, "A cat saw a Cat. No! ... x. dog"), (2, None), (3, "nothing")], "id int, t string")
    out = summaries.sentence_importance(rows, "id", "t", ["cat"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # cat twice, saw once, of five words; "No" once of one; "." has no word; x is too short.
    want = {0: 0.25 + 0.07 + 0.06 + 0.25 * 0.5, 1: 0.25 + 0.06 + 0.25 * 0.5, 2: 0.25 + 0.06, 3: 0.125 + 0.06}
    got = {(r["id"], r["place"]): round(r["score"], 9) for r in out.collect()}
    assert got == {(1, place): round(score, 9) for place, score in want.items()}


def test_last_sentence_of_a_long_text_and_dates_once(spark):
    """A pattern that ends at the end of a text went back over every sentence from each of its characters; a career's dates were read up to four times."""
    from inkwright.operators import citation_units

    long = "x" * 60_000 + "。" + "y" * 60_000
    texts = [long + "。 ", "", " a. b!?", "。。", "a", "a\n。b\n。", "A.b "]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", citation_units.last_sentence(F.col("t")).alias("s")).orderBy("i")
    assert [r["s"] for r in rows.collect()] == ["y" * 60_000 + "。", "", " b!?", "。。", "a", "b\n。", "b"]
    assert time.time() - began < 20
    found = narratives.person_blocks(spark.createDataFrame([(1, "昭和3年 満鉄調査部 勤務")], "i int, text string"))
    assert len(found._jdf.queryExecution().analyzed().toString()) < 12_000  # 22,170 with each date spelled out where it is used


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_printed_numbers_are_read_once(spark, sf_dir):
    """Numbers of a page were read for the filter, for the steps and for the runs; lines were cleaned one by one."""
    lines = "- 12 -\r\n十二\n\tO5\n12a\n第3\n\n3001\n0\n二千九百\n1234567890123\n一二\x0b\f.\n—7_"
    pages = spark.createDataFrame([(1, lines), (2, ""), (3, None)], "i int, t string")
    assert [r[0] for r in pages.orderBy("i").select(page_mapping.lone_numbers(F.col("t"))).collect()] == [[5, 7, 12, 2900], [], None]
    books = spark.createDataFrame([(b, s, f"{2 * s}\n{2 * s + 1}") for b in (1, 2) for s in range(4)], "book int, scan int, text string")
    found = page_mapping.visible_anchors(books)
    assert sorted((r["book"], r["anchor_scan"], r["anchor_book"], r["pages_per_scan"]) for r in found.collect()) == [(1, 1, 2, 2), (2, 1, 2, 2)]
    plan = _plan(found).split("Initial Plan")[0]
    assert plan.count("regexp_extract_all") == 1 and plan.count("ReusedExchange") == 1


def test_what_a_worker_holds(spark, tmp_path):
    """Chunks leave in bounded frames, vectors are scored in slices, UTF-8 files are not sent to Python."""
    import numpy as np

    from inkwright.operators import retrieval, splitting, vector_index
    from inkwright.sources import readers

    text = "abc. " * 5_000
    got = splitting.chunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), lambda t: [(k, k + 3, "") for k in range(0, len(t), 5)])
    assert got.count() == 5_000 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20) and splitting.OUT_ROWS < 5_000
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(5_000)], "vec_id long, embedding array<double>").coalesce(1).cache()
    few = rows.filter("vec_id % 1000 = 0")
    found = retrieval.batch_top_k(few, rows, 3)
    x = np.stack([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for r in found.groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).collect():
        assert np.allclose(r["s"], np.sort(unit @ unit[r["query_id"]])[-3:])
    index = vector_index.build(rows, str(tmp_path / "index"), lists=3)
    near = vector_index.nearest_lists(rows, index)
    assert near.count() == 15_000 and near.groupBy("vec_id").agg(F.count_distinct("list").alias("n")).filter("n <> 3").count() == 0
    (tmp_path / "texts").mkdir()
    for name, raw in (("a", "\ufeff海b".encode()), ("b", "海路".encode("shift_jis")), ("d", "海\ufeff".encode())):
        (tmp_path / "texts" / f"{name}.txt").write_bytes(raw)
    texts = readers.documents(spark, str(tmp_path / "texts"))
    assert {r["name"]: r["text"] for r in texts.collect()} == {"a.txt": "海b", "b.txt": "海路", "d.txt": "海\ufeff"}
    assert "isnull" in texts._jdf.queryExecution().analyzed().toString().lower()


def test_work_on_small_tables_is_dealt(spark, sf_dir):
    """A file of parts is one task, however much each of its rows has to do."""
    from inkwright.plans import built, curation, dates, reviews

    for queries, name in ((dates, "d02_text_dates"), (dates, "g13_publication_year"), (built, "e18_page_furniture"), (reviews, "z04_rule_entities"), (curation, "g10_term_profile")):
        plan = _plan(queries.QUERIES[name](spark, sf_dir))
        assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1, name


def test_numerals_and_shapes_are_spelled_out_once(spark):
    from inkwright.functions import dates
    from inkwright.operators import screening, summaries

    texts = ["廿三", "123456789", "二千三百四", "元", "百十", "卅a", "", "〇五", "1万"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(dates.kanji_number(F.col("t"))).collect()]
    assert got == [23, 123456789, 2304, 1, 110, None, None, 5, None]
    assert str(dates.kanji_number(F.regexp_extract("t", "x", 0))).count("regexp_extract") == 1
    assert str(screening.page_numeral(F.regexp_extract("t", "x", 0))).count("regexp_extract(t") == 1
    assert str(summaries.sentence_shape(F.col("t"), [])).count("regexp_extract_all") == 1


def test_pages_read_their_rows_once(spark, sf_dir):
    """A body, notes, marks and pages each read the rows anew, and these six kinds of boxes: two dozen scans."""
    from inkwright.operators import layout
    from inkwright.plans.papers import QUERIES

    rows = spark.createDataFrame([(1, 1, 0, 50.0, "a①", "body"), (1, 1, 1, 90.0, "b②", "body"), (1, 1, 2, 900.0, "① x", "note"), (1, 1, 3, 910.0, "y", "note"), (1, 1, 4, 920.0, "② z", "note"), (1, 2, 0, 20.0, "head", None)], "doc long, page long, row int, y0 double, text string, zone string")
    out = layout.paper_pages(rows)
    assert [(r["page"], r["text"], [tuple(n) for n in r["notes"]], r["flags"]) for r in out.orderBy("page").collect()] == [(1, "a b", [("p1n1", 1), ("p1n2", 3)], []), (2, "", [], [])]
    assert "Join" not in _plan(out)
    assert _plan(QUERIES["s20_paper_pages"](spark, sf_dir)).count("FileScan") == 2


def test_rows_of_pages_go_on_over_batches(spark):
    from inkwright.operators import layout

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), (5, 9.0), (5, 30.0), (5, 31.0)], "page long, y double").coalesce(1)
    assert [r["row"] for r in layout.in_rows(rows, ["page"], "y", 3.0).collect()] == [0, 0, 1, 0, 1, 1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_a_stream_asks_its_state_once_a_key():
    """Open starts were asked for, and changed, event by event."""
    import pandas as pd

    from inkwright.streaming import progress

    class State(dict):
        calls = 0

        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, key, value):
            self.calls, self[key[0]] = self.calls + 1, value

        def removeKey(self, key):
            self.calls += 1
            del self[key[0]]

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    reports = progress.Reports(0)
    reports.begun, reports.summary = State(old=(1,)), Value()
    kinds = [("candidate_started", "")] + [(k, s) for s in ("a", "b") for _ in range(50) for k in ("worker_stage_started", "worker_stage_completed")] + [("worker_stage_completed", "old"), ("worker_stage_started", "c"), ("candidate_completed", "")]
    rows = pd.DataFrame([(k, s, "ok", n, n) for n, (k, s) in enumerate(kinds)], columns=["kind", "subphase", "status", "us", "ordinal"])
    out = list(reports.handleInputRows(("p", "", "x"), iter([rows]), None))
    assert len(out) == 1 and out[0]["subphases"][0] == 101 and dict(reports.begun) == {"c": (202,)}
    assert reports.begun.calls == 2
