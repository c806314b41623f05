"""Queries for dates, evidence and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as T
from ..operators import evidence as V
from ..operators import extraction as E
from ..operators import runs as U
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT p_partkey, COALESCE(CASE era WHEN '明治' THEN 1868 WHEN '大正' THEN 1912 WHEN '昭和' THEN 1926 END + p_size - 1, -1) AS year FROM (SELECT p_partkey, p_size, ['明治', '大正', '昭和', '無名'][(p_partkey % 4)::INT + 1] AS era FROM part)")
def d01_era_year(spark, sf_dir):
    era = F.get(F.array(*map(F.lit, ("明治", "大正", "昭和", "無名"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.era_year(era, F.col("p_size")), F.lit(-1)).alias("year"))


@query("SELECT p_partkey, p_partkey::INT AS value FROM part WHERE p_partkey BETWEEN 1 AND 9999")
def d06_kanji_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey BETWEEN 1 AND 9999")
    return p.select("p_partkey", T.kanji_number(T.to_kanji(F.col("p_partkey"))).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey >= 5 THEN 11 + (p_partkey - 5) // 2 ELSE 0 END::INT AS scan, CASE WHEN p_size >= 11 THEN 5 + (p_size - 11) * (1 + p_size % 3) ELSE 0 END::INT AS first_page, CASE WHEN p_size >= 11 THEN 1 + p_size % 3 ELSE 0 END::INT AS pages FROM part")
def d08_scan_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    scan = T.scan_page(F.col("p_partkey"), F.lit(11), F.lit(5), F.lit(2))
    back = T.book_pages(F.col("p_size"), F.lit(11), F.lit(5), 1 + F.col("p_size") % 3)
    return p.select("p_partkey", F.coalesce(scan, F.lit(0)).cast("int").alias("scan"), F.coalesce(F.get(back, F.lit(0)), F.lit(0)).alias("first_page"), F.size(back).alias("pages"))


@query("SELECT o_orderkey, CASE WHEN d < 30 THEN 95 WHEN d < 90 THEN 85 WHEN d < 180 THEN 75 WHEN d < 365 THEN 65 ELSE 55 END::DOUBLE AS score FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS d FROM orders)")
def r19_recency(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.recency_score(F.to_date("o_orderdate"), F.lit("1998-12-31").cast("date")).alias("score"))


@query("SELECT p_partkey, round(least(p_retailprice / 10000, 1.0) * 40 + least(p_size * 100 / 2000, 1.0) * 35 + least(p_partkey / 5000, 1.0) * 25, 1) AS score FROM part")
def r20_popularity(spark, sf_dir):
    score = T.popularity_score(F.col("p_retailprice"), F.col("p_size") * 100, F.col("p_partkey"), digits=1)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("SELECT event_id, CASE WHEN v >= 0.45 THEN 'direct_support' WHEN v >= 0.16 OR (c >= 0.25 AND m >= 2) THEN 'partial_support' ELSE 'not_supported' END AS decision FROM (SELECT event_id, (event_id % 60) / 100.0 AS v, (event_id % 7) / 10.0 AS c, event_id % 4 AS m FROM events)")
def r27_review_decision(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", V.review_decision((i % 60) / 100, (i % 7) / 10, i % 4).alias("decision"))


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value < 1 THEN 'source_mismatch' WHEN event_type = 'purchase' AND value > 10 THEN 'verified_with_source' WHEN value > 5 THEN 'source_found' WHEN event_type = 'view' THEN 'pending' ELSE 'source_not_found' END AS status FROM events")
def m10_status(spark, sf_dir):
    kind, v = F.col("event_type"), F.col("value")
    status = F.when(kind == "purchase", "verified").when(kind == "view", "pending").otherwise("open")
    return table(spark, sf_dir, "events").select("event_id", U.status_class(status, v > 10, v > 5, (kind == "click") & (v < 1)).alias("status"))


@query("SELECT id, start, stop, c_start, c_stop FROM (SELECT *, row_number() OVER (PARTITION BY id, start, stop ORDER BY c_stop - c_start, ordinal) AS r FROM (SELECT a.label AS id, a.vec_id AS start, a.vec_id + 1 AS stop, b.vec_id - 20 - b.vec_id % 13 AS c_start, b.vec_id + b.vec_id % 7 AS c_stop, b.vec_id AS ordinal FROM embeddings a JOIN embeddings b ON a.label = b.label) WHERE c_start <= start AND c_stop >= stop) WHERE r = 1")
def j08_narrowest_range(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("label").alias("id"), F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("stop"))
    v = F.col("vec_id")
    cached = e.select(F.col("label").alias("id"), (v - 20 - v % 13).alias("c_start"), (v + v % 7).alias("c_stop"), v.alias("ordinal"))
    return V.narrowest_range(asked, cached).select("id", "start", "stop", "c_start", "c_stop")


@query("SELECT l_orderkey, page FROM (SELECT l_orderkey, l_quantity AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_quantity BETWEEN 20 AND 25) DESC, CASE WHEN l_quantity BETWEEN 20 AND 25 THEN 0 ELSE abs(l_quantity - 22.5) END, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def j09_preferred_hit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ordinal"))
    windows = items.select("l_orderkey").distinct().withColumns({"low": F.lit(20), "high": F.lit(25)})
    return V.preferred_hit(items, windows, "l_orderkey").select("l_orderkey", "page")


@query("SELECT event_id, COALESCE(lag_id, -1) AS defined_at, COALESCE(lag_value, -1) AS defined_value FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS lag_id, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') OVER w AS lag_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def j13_previous_definition(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("definition"))
    return V.previous_definition(e, "user_id", "event_id", "definition").select("event_id", F.coalesce("defined_at", F.lit(-1).cast("long")).alias("defined_at"), F.coalesce("defined_value", F.lit(-1.0)).alias("defined_value"))


@query("SELECT p_partkey, list_min(list_transform([5, 17, 40], lambda x: abs(x - p_size)))::INT AS distance FROM part")
def j10_page_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.page_distance(F.col("p_size"), F.array(F.lit(5), F.lit(17), F.lit(40))).alias("distance"))


@query("SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'no_pdf_page' WHEN p_size % 7 = 0 THEN 'fulltext_pdf_page_only' WHEN p_size BETWEEN 10 AND 20 THEN 'fulltext_page_inside_downloaded_window' ELSE 'fulltext_page_outside_downloaded_window' END AS page_status FROM part")
def r31_page_check(spark, sf_dir):
    page, low = F.when(F.col("p_size") % 9 != 0, F.col("p_size")), F.when(F.col("p_size") % 7 != 0, 10)
    return table(spark, sf_dir, "part").select("p_partkey", V.page_check(page, low, F.lit(20)).alias("page_status"))


@query("SELECT doc_id, w.word AS entity, (k - 1)::BIGINT AS start FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS k FROM documents) d JOIN (VALUES ('thing'), ('hin'), ('qui ')) w(word) ON substr(d.text, d.k, length(w.word)) = w.word")
def e12_dictionary_entities(spark, sf_dir):
    words = spark.createDataFrame([("thing", "noun"), ("hin", "part"), ("qui ", "pronoun")], "entity string, category string")
    return E.dictionary_entities(table(spark, sf_dir, "documents"), words).select("doc_id", "entity", F.col("start").cast("long").alias("start"))


@query("SELECT doc_id, (doc_id % 5 + unnest([1, 2, 3]))::INT AS page FROM documents")
def d10_page_explode(spark, sf_dir):
    pages = F.expr("concat(doc_id % 5 + 1, '-', doc_id % 5 + 3)")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.page_list(pages)).alias("page"))
