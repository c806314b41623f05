from pyspark.sql import functions as F

from inkwright.operators import facets as T
from inkwright.operators.evidence import match_text

RULES = "ord int, bucket string, role string, patterns array<string>, triggers array<string>, terms array<string>"
ROWS = [
    (1, "us", "country", ["amer(ica|ika)"], None, ["米国", "亜米利加"]),
    (2, "economy", None, None, ["経済", "trade"], ["富", "財政"]),
    (3, "us", "", ["("], ["合衆国"], ["米国", "北米"]),
    (4, "future_influence", "theme", None, ["将来"], ["将来", "前途", "後日"]),
    (5, "empty", "theme", None, ["将来"], [" ", None]),
    (6, "us", "country", None, [""], ["X"]),
]


def faceted(spark, claims, rules=ROWS):
    df = spark.createDataFrame(claims, "id long, claim string")
    return T.claim_facets(df, spark.createDataFrame(rules, RULES))


def test_facets_of_claims(spark):
    got = {r["id"]: [(f["bucket"], f["role"], [t["term"] for t in f["terms"]]) for f in r["facets"]] for r in faceted(spark, [(1, "AMERICA と合衆國の T-rade、将来"), (2, "Ａｍｅｒｉｋａ"), (3, "nothing"), (4, None), (5, "")]).collect()}
    us = ("us", "country", ["米国", "亜米利加", "北米"])
    assert got == {1: [us, ("economy", "theme", ["富", "財政"]), ("future_influence", "theme", ["将来", "前途", "後日"])], 2: [("us", "country", ["米国", "亜米利加"])], 3: [], 4: [], 5: []}
    assert [r["facets"] for r in faceted(spark, [(1, "America")], [(1, "b", None, None, None, ["t"])]).collect()] == [[]]
    assert faceted(spark, [(1, "America")]).limit(0).collect() == []


def test_packets(spark):
    claims = faceted(spark, [(1, "America trade 将来"), (2, "trade 将来"), (3, "none"), (4, "America trade")])
    contexts = spark.createDataFrame([(1, "a", "米国ノ財政ト富、前途"), (1, "b", "北米"), (1, "c", "米国"), (2, "a", "富 将来"), (2, "b", None), (3, "a", "米国"), (4, "a", "亜米利加 富"), (1, "d", "財政 後日")], "id long, page string, text string")
    got = {(r["id"], r["page"]): (r["covered"], r["missing"], round(r["bonus"], 4), [tuple(h["terms"]) for h in r["hits"]]) for r in T.facet_packets(claims, contexts).collect()}
    assert got == {
        (1, "a"): (["economy", "future_influence", "us"], [], 4.2, [("米国",), ("富", "財政"), ("前途",)]),
        (1, "c"): (["us"], ["economy", "future_influence"], 0.9, [("米国",)]),
        (1, "d"): (["economy", "future_influence"], ["us"], 2.15, [("財政",), ("後日",)]),
        (2, "a"): (["economy", "future_influence"], [], 2.15, [("富",), ("将来",)]),
        (4, "a"): (["economy", "us"], [], 2.55, [("亜米利加",), ("富",)]),
    }


def test_bonus_of_anchors_and_themes(spark):
    forms = [[("p", "person"), ("a", "theme"), ("b", "theme")], [("p", "place"), ("a", "theme")], [("a", "theme"), ("b", "theme")], [("a", "theme")], [(c, "theme") for c in "abcdefg"]]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f array<struct<bucket string, role string>>")
    got = [round(r["b"], 4) for r in rows.select("i", T.facet_bonus(F.col("f")).alias("b")).orderBy("i").collect()]
    assert got == [3.95, 2.45, 2.15, 0.9, 4.35]


def asked(spark, claim, dates, rules=ROWS):
    df = faceted(spark, [(1, claim)], rules).withColumn("d", F.array(*map(F.lit, dates)).cast("array<string>"))
    return df.select(T.facet_queries(F.col("facets"), T.date_anchors(F.col("d"))).alias("q")).first()["q"]


def test_queries(spark):
    got = asked(spark, "America trade 将来", ["1919年", "大正八年一月", "1月5日", "1月6日"])
    full = [f"{d} {a} {t}" for t in ("富", "財政", "将来", "前途", "後日") for d in ("大正八年一月", "1月5日") for a in ("米国", "亜米利加")]
    assert got == full[:18]
    assert asked(spark, "America", ["1919", "1920年"]) == ["1919 米国", "1919 亜米利加", "1920年 米国", "1920年 亜米利加"]
    assert asked(spark, "America trade 将来", []) == ["米国 富 将来", "米国 富 前途", "米国 財政 将来", "米国 財政 前途", "亜米利加 富 将来", "亜米利加 富 前途", "亜米利加 財政 将来", "亜米利加 財政 前途"] + [f"{a} {b}" for a in ("米国", "亜米利加", "富", "財政") for b in ("米国", "亜米利加", "富", "財政", "将来", "前途") if a != b][:10]
    assert asked(spark, "trade", ["1月5日"]) == [f"1月5日 {a} {t}" for t in ("富", "財政") for a in ("富", "財政")]
    assert asked(spark, "none", ["1月5日"]) == []


def test_reranked(spark):
    matches = spark.createDataFrame(
        [
            (1, 0, "s0", "t", "a", "p", "1920", 0.9, True, 1),
            (1, 1, "s1", "外交史", None, "東京堂", "大正9(1920)", 0.5, False, 3),
            (1, 2, "s2", "t", None, "Other", "1921", 0.9, None, 0),
            (1, 3, "s3", "t", None, None, None, 0.7, False, 2),
            (1, 4, None, "t", None, None, None, 0.7, False, 2),
            (2, 0, "s1", None, None, None, None, None, False, None),
            (2, 1, "s2", None, None, None, None, None, False, None),
        ],
        "id long, ordinal int, source_id string, title string, author string, publisher string, date string, score double, mismatch boolean, source_rank int",
    )
    candidates = spark.createDataFrame([(1, "1920年", "東京堂")], "id long, year string, publisher string")
    hints = spark.createDataFrame([(1, "s3", "q", "x", 4, True), (1, "s3", "門戸開放", "民ヲ安ズル", None, True), (1, "s2", "q", None, 7, False), (1, "other", "q", "門戶開放", 1, True)], "id long, source_id string, query string, snippet string, pdf_page int, specific boolean")
    got = sorted((r["id"], r["place"], r["ordinal"], round(r["weight"], 4)) for r in T.reranked_matches(matches, candidates, hints).collect())
    assert got == [(1, 1, 3, 2.8), (1, 2, 4, 2.8), (1, 3, 1, 1.5), (1, 4, 2, 0.25), (1, 5, 0, 1.25), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]


def test_match_texts(spark):
    texts = ["國會ノ 戰（注）體", "Ａ.B, c！d", "(a） b [c]-「d」", "１,2", "人", None, "", "　\u00a0x\t", "!?/", "open (end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["m"] for r in rows.select("i", match_text(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == ["国会ノ戦体", "a.b,c!d", "bcd", "1,2", "亻", "", "", "x", "!?/", "openend"]
