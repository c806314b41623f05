"""Queries on configured facets and on matches ranked again; claims, contexts, matches and hints come from the tables, rules are configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as T
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: (ord, bucket, role, patterns, triggers, terms): the configuration of these queries.
RULES = [
    (1, "us", "country", ["^(Red|blue) "], None, ["red", "blue"]),
    (2, "economy", "theme", None, ["Econ omy"], ["gear", "ring"]),
    (3, "future_influence", None, ["pro(mo|test)", "("], None, ["bolt", "rod"]),
    (4, "us", "country", None, ["large"], ["blue", "large"]),
    (5, "vitality", "theme", ["never"], ["hot", ""], ["anvil"]),
]
_FACETED = """claims AS (SELECT p_partkey AS id, p_size, regexp_matches(p_name, '^(red|blue) ') AS a, p_type = 'ECONOMY' AS b, p_type = 'PROMO' AS c, contains(p_name || p_type, 'large') OR p_type = 'LARGE' AS d, contains(p_name, 'hot') AS e FROM part),
facets AS (SELECT *, CASE WHEN a AND d THEN ['red', 'blue', 'large'] WHEN a THEN ['red', 'blue'] WHEN d THEN ['blue', 'large'] ELSE []::VARCHAR[] END AS us, CASE WHEN b THEN ['gear', 'ring'] ELSE []::VARCHAR[] END AS eco, CASE WHEN c THEN ['bolt', 'rod'] ELSE []::VARCHAR[] END AS fut, CASE WHEN e THEN ['anvil'] ELSE []::VARCHAR[] END AS vit FROM claims)"""
_TOLD = lambda name, words: f"CASE WHEN len({words}) > 0 THEN ['{name}:' || array_to_string({words}, ',')] ELSE []::VARCHAR[] END"


def _claims(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("claim"), "p_size")
    rules = spark.createDataFrame(RULES, "ord int, bucket string, role string, patterns array<string>, triggers array<string>, terms array<string>")
    return T.claim_facets(part, rules)


def _spelled(facets):
    return F.array_join(F.transform(facets, lambda f: F.concat_ws(":", f["bucket"], F.array_join(F.transform(f["terms"], lambda t: t["term"]), ","))), ";")


@query(f"WITH {_FACETED} SELECT id, array_to_string(list_concat(CASE WHEN a THEN {_TOLD('us', 'us')} ELSE []::VARCHAR[] END, {_TOLD('economy', 'eco')}, {_TOLD('future_influence', 'fut')}, CASE WHEN a THEN []::VARCHAR[] ELSE {_TOLD('us', 'us')} END, {_TOLD('vitality', 'vit')}), ';') AS facets FROM facets")
def z19_claim_facets(spark, sf_dir):
    return _claims(spark, sf_dir).select("id", _spelled(F.col("facets")).alias("facets"))


@query(
    f"""WITH {_FACETED}, held AS (SELECT l_orderkey, l_linenumber, f.id, us, eco, fut, vit, [x FOR x IN us IF contains(p_name, x)] AS hu, [x FOR x IN eco IF contains(p_name, x)] AS he, [x FOR x IN fut IF contains(p_name, x)] AS hf, [x FOR x IN vit IF contains(p_name, x)] AS hv
 FROM lineitem JOIN facets f ON f.id = l_partkey JOIN part c ON c.p_partkey = l_suppkey),
told AS (SELECT *, len(hu) > 0 AS u, len(he) > 0 AS e, len(hf) > 0 AS f, len(hv) > 0 AS v, (len(hu) > 0)::INT + (len(he) > 0)::INT + (len(hf) > 0)::INT + (len(hv) > 0)::INT AS n FROM held)
SELECT l_orderkey, l_linenumber, id, concat_ws(',', CASE WHEN e THEN 'economy' END, CASE WHEN f THEN 'future_influence' END, CASE WHEN u THEN 'us' END, CASE WHEN v THEN 'vitality' END) AS covered,
 concat_ws(',', CASE WHEN NOT e AND len(eco) > 0 THEN 'economy' END, CASE WHEN NOT f AND len(fut) > 0 THEN 'future_influence' END, CASE WHEN NOT u AND len(us) > 0 THEN 'us' END, CASE WHEN NOT v AND len(vit) > 0 THEN 'vitality' END) AS missing,
 round(least(5.0, least(4.0, n * 0.9) + CASE WHEN u AND e AND f THEN 1.5 WHEN u AND (e OR f) THEN 0.75 WHEN u AND v THEN 0.65 WHEN n >= 2 THEN 0.35 ELSE 0 END)::DOUBLE, 4) AS bonus, len(hu) + len(he) + len(hf) + len(hv) AS hits FROM told WHERE n > 0"""
)
def z19_facet_packets(spark, sf_dir):
    """Contexts of a part are the names of its suppliers' namesakes among the parts."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("text"))
    contexts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), "l_suppkey").join(names, "l_suppkey").drop("l_suppkey")
    out = T.facet_packets(_claims(spark, sf_dir), contexts)
    hits = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + F.size(h["terms"]))
    return out.select("l_orderkey", "l_linenumber", "id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), F.round("bonus", 4).alias("bonus"), hits.alias("hits"))


_ONCE = lambda items: f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@query(
    f"""WITH {_FACETED}, lists AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN [(1900 + p_size) || '年'] ELSE [p_size || '日', '大正' || p_size || '年'] END AS dates, list_concat(eco, fut, vit) AS themed, CASE WHEN a THEN list_concat(us[1:2], eco, fut, vit) ELSE list_concat(eco, fut, us[1:2], vit) END AS every FROM facets),
chosen AS (SELECT *, CASE WHEN len(us) > 0 THEN us ELSE every END AS anchors FROM lists),
themes AS (SELECT *, CASE WHEN len(themed) > 0 THEN themed ELSE [x FOR x IN every IF NOT list_contains(anchors, x)] END AS themes FROM chosen),
forms AS (SELECT id, list_concat(flatten([flatten([[d || ' ' || x || ' ' || t FOR x IN anchors[1:2]] FOR d IN dates]) FOR t IN themes[1:6]]), CASE WHEN len(themes) = 0 THEN flatten([[d || ' ' || x FOR x IN anchors[1:4]] FOR d IN dates]) ELSE []::VARCHAR[] END,
 flatten([list_concat(flatten([[x || ' ' || s || ' ' || t FOR t IN fut] FOR s IN eco]), flatten([[x || ' ' || s || ' ' || t FOR t IN fut] FOR s IN vit])) FOR x IN anchors[1:3]]),
 CASE WHEN (len(us) > 0)::INT + (len(eco) > 0)::INT + (len(fut) > 0)::INT + (len(vit) > 0)::INT >= 2 THEN flatten([[s || ' ' || t FOR t IN every[1:6] IF t <> s] FOR s IN every[1:4]]) ELSE []::VARCHAR[] END) AS q FROM themes WHERE len(every) > 0)
SELECT id, array_to_string(({_ONCE('q')})[1:18], ';') AS queries FROM forms"""
)
def z20_facet_queries(spark, sf_dir):
    size = F.col("p_size").cast("string")
    dates = F.when(F.col("p_size") % 5 == 0, F.array(F.concat((F.col("p_size") + 1900).cast("string"), F.lit("年")))).otherwise(F.array(F.concat(F.lit("1919"), F.lit("年")), F.concat(size, F.lit("日")), F.concat(F.lit("大正"), size, F.lit("年"))))
    queries = F.array_join(T.facet_queries(F.col("facets"), T.date_anchors(dates)), ";")
    # As elements of an array the queries are not computed once more for a filter.
    return _claims(spark, sf_dir).select("id", F.explode(F.array_compact(F.array(F.nullif(queries, F.lit(""))))).alias("queries"))


@query(
    """WITH m AS (SELECT l_orderkey AS id, l_linenumber AS ordinal, 's' || (l_suppkey % 5) AS sid, l_suppkey % 7 = 0 AS anonymous, p_name, p_type, year(l_shipdate) AS y, l_discount AS score, l_returnflag = 'R' AS mismatch, l_partkey % 4 AS source_rank FROM lineitem JOIN part ON p_partkey = l_partkey),
h AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 11 <> 0 THEN 's' || (l_partkey % 5) END AS hid, 1.0 + CASE WHEN l_partkey % 6 = 0 THEN 0.8 ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 0.5 ELSE 0 END + CASE WHEN l_partkey % 3 > 0 THEN 0.1 ELSE 0 END AS bonus FROM lineitem WHERE l_linestatus = 'O'),
own AS (SELECT id, hid, max(bonus) AS bonus FROM h GROUP BY ALL), every AS (SELECT id, max(bonus) AS bonus, max(bonus) FILTER (hid IS NULL) AS open FROM h GROUP BY id),
w AS (SELECT m.*, score + CASE WHEN y = year(o_orderdate) THEN 0.55 ELSE -0.45 END + CASE WHEN o_orderkey % 3 = 2 THEN 0 WHEN o_orderkey % 3 = 0 AND p_type = 'ECONOMY' OR o_orderkey % 3 = 1 AND contains(p_type || p_name, 'red') THEN 0.45 ELSE -0.2 END
 + CASE WHEN anonymous THEN COALESCE(every.bonus, 0) ELSE COALESCE(greatest(own.bonus, every.open), 0) END AS weight FROM m JOIN orders ON o_orderkey = m.id LEFT JOIN own ON own.id = m.id AND own.hid = sid LEFT JOIN every ON every.id = m.id)
SELECT id, ordinal, round(weight::DOUBLE, 2) AS weight, row_number() OVER (PARTITION BY id ORDER BY mismatch, round(weight::DOUBLE, 6) DESC, CASE WHEN source_rank = 0 THEN 9999 ELSE source_rank END, ordinal) AS place FROM w"""
)
def t_k12_reranked_matches(spark, sf_dir):
    """Lines of orders as matches and as hints, orders as candidates."""
    lines, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    named = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    source = lambda c: F.concat(F.lit("s"), (F.col(c) % 5).cast("string"))
    matches = named.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_suppkey") % 7 != 0, source("l_suppkey")).alias("source_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("author"),
        F.col("p_type").alias("publisher"), F.concat(F.lit("c"), F.year("l_shipdate").cast("string")).alias("date"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("mismatch"), (F.col("l_partkey") % 4).cast("int").alias("source_rank"),
    )
    third = F.col("o_orderkey") % 3
    candidates = orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("string").alias("year"), F.when(third == 0, "Economy").when(third == 1, "red").alias("publisher"))
    key = F.col("l_partkey")
    hints = lines.select(
        F.col("l_orderkey").alias("id"), F.when(key % 11 != 0, source("l_partkey")).alias("source_id"), F.when(key % 4 == 0, "門戸 開放").otherwise("q").alias("query"), F.when(key % 6 == 0, "民ヲ安ズル").alias("snippet"), (key % 3).cast("int").alias("pdf_page"), (F.col("l_linestatus") == "O").alias("specific")
    )
    out = T.reranked_matches(matches, candidates, hints)
    return out.select("id", "ordinal", F.round("weight", 2).alias("weight"), "place")
