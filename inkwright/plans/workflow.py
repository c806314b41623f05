"""Queries for workflow tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as W
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT doc_id, place, relation, pattern FROM documents, (VALUES (1, 'located_in', '在', 2), (2, 'located_in', '属于', 3), (5, 'participated_in', '出席', 5), (6, 'founded', '创建', 7), (11, 'ruled_by', '管辖', 11)) t(place, relation, pattern, m) WHERE text IS NOT NULL AND doc_id % m = 0")
def e14_relations(spark, sf_dir):
    cues = [F.when(F.col("doc_id") % m == 0, word).otherwise("") for word, m in (("管辖", 11), ("创建", 7), ("出席", 5), ("属于", 3), ("在", 2))]
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("text", F.concat("text", *cues))
    return W.relations(d).select("doc_id", "place", "relation", "pattern")


@query("SELECT conv_id, md5(COALESCE(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn BETWEEN 1 AND 6 AND t <> ''), '')) AS digest, md5(COALESCE(string_agg('<block_' || turn || '>' || chr(10) || t || chr(10) || '</block_' || turn || '>', chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn BETWEEN 1 AND 6 AND t <> ''), '')) AS marked, (6 - count(DISTINCT turn) FILTER (WHERE turn BETWEEN 1 AND 6))::INT AS missing FROM (SELECT conv_id, turn, regexp_replace(text, '^[\\s\\x0B　]+|[\\s\\x0B　]+$', '', 'g') AS t FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def z29_page_texts(spark, sf_dir):
    """Turns as the blocks of a page."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block"), "text")
    return W.page_texts(c, "conv_id").select("conv_id", F.md5("text").alias("digest"), F.md5("marked").alias("marked"), F.size("missing").alias("missing"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS success, count(*) FILTER (WHERE lang <> 'en') AS failed, sum(CASE WHEN lang = 'en' THEN length(text) ELSE 0 END)::BIGINT AS characters, round(avg(CASE WHEN lang = 'en' THEN length(text) END), 4) AS mean_characters, round(avg(CASE WHEN lang = 'en' THEN 100.0 ELSE 0.0 END), 2) AS success_percent FROM documents")
def z32_ocr_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "en", "success").otherwise("failed"))
    return W.ocr_statistics(d).withColumn("mean_characters", F.round("mean_characters", 4))


@query("SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS entry FROM conversations")
def w10_entry_ids(spark, sf_dir):
    return W.entry_ids(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "entry")


@query("WITH l AS (SELECT conv_id, turn, role = 'assistant' AND turn % 4 = 3 AS t, turn % 4 IN (1, 2) AS h FROM conversations), p AS (SELECT *, h AND (COALESCE(lead(t, 1) OVER w, false) OR (COALESCE(lead(h, 1) OVER w, false) AND COALESCE(lead(t, 2) OVER w, false)) OR (COALESCE(lead(h, 1) OVER w, false) AND COALESCE(lead(h, 2) OVER w, false) AND COALESCE(lead(t, 3) OVER w, false))) AS pulled FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT *, ((pulled OR t) AND NOT COALESCE(lag(pulled) OVER (PARTITION BY conv_id ORDER BY turn), false))::INT AS fresh FROM p) SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS entry FROM f")
def w10_entries_with_headings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return W.entry_ids(c, "conv_id", "turn", (F.col("role") == "assistant") & (F.col("turn") % 4 == 3), (F.col("turn") % 4).isin(1, 2)).select("conv_id", "turn", "entry")


@query("SELECT 'N' || n_nationkey AS ref, row_number() OVER (ORDER BY n_nationkey)::INT AS number FROM nation UNION ALL SELECT 'R' || r_regionkey, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey) FROM region")
def z35_numbered_references(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ref"), F.col("n_nationkey").alias("ord"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("ref"), F.col("r_regionkey").alias("ord"))
    return W.numbered_references([n, r]).select("ref", "number")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'none' WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 9 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'no_digital_pid' WHEN event_id % 3 = 1 THEN 'rights' ELSE 'unknown' END WHEN event_id % 4 = 0 THEN 'download_http_404' WHEN event_id % 4 = 1 AND event_id % 9 = 0 THEN 'print_button_not_found' WHEN event_id % 4 = 1 THEN 'no_digital_pid' WHEN event_id % 6 = 0 THEN 'remote_copy_only_no_print' ELSE 'none' END AS reason FROM events")
def z26_unavailable_reason(spark, sf_dir):
    i = F.col("event_id")
    known = F.when(i % 3 == 0, "no_digital_pid").when(i % 3 == 1, "rights").otherwise("")
    notes = F.when(i % 4 == 0, "x download_http_404 y").when(i % 4 == 1, "print_button_not_found\nrestricted_download_skipped_no_ndl_pid").when(i % 4 == 2, "")
    failures = F.when(i % 6 == 0, "{'reason': 'remote_copy_only_no_print'}")
    reason = W.unavailable_reason(i % 7 == 0, F.when(i % 5 == 0, "unavailable"), known, notes, failures, i % 9 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(reason, F.lit("none")).alias("reason"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS routes, max(value) AS score, count(DISTINCT event_id % 10) AS hints FROM events GROUP BY user_id")
def u08_merged_hints(spark, sf_dir):
    hint = F.array(F.struct(F.lit("s").alias("snippet"), (F.col("event_id") % 10).alias("page")))
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("route"), F.col("value").alias("score"), hint.alias("hints"))
    return W.merged_hints(e, "user_id").select("user_id", "routes", "score", F.size("hints").cast("long").alias("hints"))


@query("(SELECT p_partkey AS id, 'classic' AS kind FROM part WHERE 1975 + p_size < 2010 ORDER BY 1975 + p_size, p_partkey LIMIT 8) UNION ALL (SELECT p_partkey, 'frontier' FROM part WHERE 1975 + p_size >= 2010 ORDER BY 1975 + p_size DESC, p_partkey LIMIT 8)")
def t_k13_literature_split(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.lit(1975) + F.col("p_size")).cast("string").alias("year"))
    return W.literature_split(w, "year", 2025).select("id", "kind")


@query("SELECT p_partkey, CASE WHEN m THEN s ELSE greatest(1, p_size - 2) END::INT AS from_page, CASE WHEN m THEN s + 30 ELSE p_size + 39 END::INT AS to_page, CASE WHEN NOT m THEN 0 WHEN p_size >= 10 THEN 2 ELSE 1 END::INT AS mapped, CASE WHEN m THEN 'double_page_mapping_used: book_p10->scan_p3' ELSE '' END AS note FROM (SELECT *, p_partkey % 2 = 0 AND p_size + 37 >= 10 AS m, 3 + p_size AS s FROM part)")
def d09_download_plan(spark, sf_dir):
    """Two cited pages each; half of the items have a mapping."""
    mapped = F.col("p_partkey") % 2 == 0
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 37).alias("pages"), *(F.when(mapped, F.lit(v)).alias(n) for n, v in (("anchor_scan", 3), ("anchor_book", 10), ("pages_per_scan", 2))), F.when(mapped, 3 + F.col("p_size")).alias("start_scan"), F.when(mapped, 33 + F.col("p_size")).alias("end_scan"))
    return W.download_plan(p).select("p_partkey", "from_page", "to_page", F.size("mapped").alias("mapped"), "note")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def f10_selected_ids(spark, sf_dir):
    chosen = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(chosen, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT CASE grouping(c_mktsegment, n_name) WHEN 3 THEN 'all' WHEN 1 THEN 'backend' ELSE 'provider' END AS level, c_mktsegment AS backend, n_name AS provider, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name), ())")
def z34_execution_summary(spark, sf_dir):
    from ..operators.runs import grouping_statistics

    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_mktsegment").alias("backend"), F.col("n_name").alias("provider"), "c_acctbal")
    return grouping_statistics(c, "backend", "provider", {"n": F.count("*"), "total": F.round(F.sum("c_acctbal"), 2)})
