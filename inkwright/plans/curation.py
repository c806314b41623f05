"""Queries for claims, entities, selections and text cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleanup as X
from ..functions.text import bound, occurrences
from ..operators import claims as C
from ..operators import entities as N
from ..operators import selection as S
from ..operators import summaries as U
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0B 　]+', ' ', 'g'))"


def _cut(x: str, marks: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^{marks}]*[{marks}]|[^{marks}]+'), lambda p: {_clean('p')}), lambda p: length(p) > 0)"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _fold(parts: str, test: str) -> str:
    """Parts joined by `test` on the group h and the next part y; groups are parted by chr(1) on the way."""
    return f"string_split(list_reduce({parts}, lambda a, y: CASE WHEN {test.replace('{h}', 'regexp_extract(a, ' + chr(39) + '[^' + chr(92) + 'x01]*$' + chr(39) + ')')} THEN a || y ELSE a || chr(1) || y END), chr(1))"


_LIST = "doc_id, len(found) AS n, md5(array_to_string(found, chr(10))) AS digest"


def _listed(docs, found):
    return docs.filter("text IS NOT NULL").select("doc_id", found.alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.md5(F.array_join("f", "\n")).alias("digest"))


_CLAUSES = _fold(_cut("s", "，,、；;：:"), "length({h}) + length(y) <= 150")


@query(f"SELECT {_LIST} FROM (SELECT doc_id, {_once('f')} AS found FROM (SELECT doc_id, list_filter(list_transform(flatten(list_transform({_cut(_clean('text'), '。！？；;.!?')}, lambda s: CASE WHEN length(s) <= 160 THEN [s] ELSE {_CLAUSES} END)), lambda c: {_clean('c')}), lambda c: length(c) >= 4) AS f FROM documents WHERE text IS NOT NULL))")
def c13_claims(spark, sf_dir):
    return _listed(table(spark, sf_dir, "documents"), C.claims(F.col("text")))


_PAGE = _fold(_cut(_clean("text"), "。！？!?；;，、,"), "(length({h}) < 18 OR length(y) < 8)")


@query(f"SELECT {_LIST} FROM (SELECT doc_id, CASE WHEN c = '' THEN [] WHEN len(f) = 0 THEN [c] ELSE f END AS found FROM (SELECT doc_id, c, list_slice({_once('g')}, 1, 8) AS f FROM (SELECT doc_id, {_clean('text')} AS c, list_filter(list_transform({_PAGE}, lambda c: {_clean('c')}), lambda c: length(c) >= 6) AS g FROM documents WHERE text IS NOT NULL)))")
def c14_page_claims(spark, sf_dir):
    return _listed(table(spark, sf_dir, "documents"), C.page_claims(F.col("text")))


_MARKS = "。．.!！?？"


@query(f"SELECT {_LIST} FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f WHEN c <> '' THEN [c] ELSE [] END AS found FROM (SELECT doc_id, c, list_slice({_once('g')}, 1, 12) AS f FROM (SELECT doc_id, substr({_clean('text')}, 1, 260) AS c, list_filter(list_transform(regexp_extract_all(replace(text, chr(13), chr(10)), '[^\\n{_MARKS}]*[{_MARKS}]|[^\\n{_MARKS}]+'), lambda p: {_clean('p')}), lambda p: length(p) >= 4) AS g FROM documents WHERE text IS NOT NULL)))")
def c16_review_sentences(spark, sf_dir):
    return _listed(table(spark, sf_dir, "documents"), C.review_sentences(F.col("text")))


@query(f"SELECT doc_id, md5(CASE WHEN length(c) <= 260 OR best <= whole THEN c ELSE w END) AS digest FROM (SELECT doc_id, c, ((length(c) - length(replace(c, 'th', ''))) // 2) / length(c) AS whole, max(score) AS best, arg_min(w, row(-score, pos)) AS w FROM (SELECT doc_id, c, pos, substr(c, pos + 1, 220) AS w, ((length(w) - length(replace(w, 'th', ''))) // 2) / length(w) AS score FROM (SELECT doc_id, c, unnest(generate_series(0, greatest(length(c) - 220, 0), 60)) AS pos FROM (SELECT doc_id, {_clean('text')} AS c FROM documents WHERE length(trim(text)) > 0))) GROUP BY doc_id, c)")
def w15_best_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length(F.btrim("text", F.lit(C.SPACES))) > 0)
    score = lambda t: occurrences(t, F.lit("th")) / F.length(t)
    # Rows that repeat a document and its cleaned text count once.
    found = bound(C.window_text(F.col("text")), lambda t: F.struct(F.md5(t).alias("cleaned"), F.md5(C.best_part(t, score)).alias("digest")))
    return d.select("doc_id", found.alias("f")).distinct().select("doc_id", "f.digest")


@query("SELECT o_custkey, count(*) FILTER (WHERE t <> '') AS aligned_claims, count(*) AS total_claims, round(avg(CASE WHEN t <> '' THEN c END), 4) AS average_confidence, arg_max(p, row(c, -k)) AS best_page, max(c) AS best_confidence FROM (SELECT o_custkey, o_orderkey AS k, o_orderkey % 90 AS p, (o_orderkey * 37 % 997) / 997.0::DOUBLE AS c, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'x' END AS t FROM orders) GROUP BY o_custkey HAVING count(*) FILTER (WHERE t <> '') > 0")
def g27_claim_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey AS claim_index", "o_orderkey % 90 AS matched_page", "(o_orderkey * 37 % 997) / 997.0D AS confidence", "CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'x' END AS matched_text")
    return C.claim_summary(o, "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 = l_linenumber) AS is_cited FROM lineitem")
def j11_cited_pages(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "CAST(o_orderkey % 7 AS INT) AS l_linenumber")
    return C.cited_pages(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), cited, ["l_orderkey", "l_linenumber"])


@query("SELECT 'p' || p || '-f' || f AS candidate_id, p AS paragraph, f AS footnote_id, length(text) AS size FROM (SELECT conv_id * 100 + turn AS p, text, unnest([conv_id % 17, turn + 20]) AS f FROM conversations) WHERE f < 30 AND f % 3 <> 0 AND length(trim(text)) > 0")
def j02_citation_candidates(spark, sf_dir):
    paragraphs = table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS paragraph", "text", "array(conv_id % 17, turn + 20) AS footnote_ids")
    notes = spark.range(30).selectExpr("id AS footnote_id", "id % 3 <> 0 AS verifiable")
    return C.citation_candidates(paragraphs, notes).select("candidate_id", "paragraph", "footnote_id", F.length("text").cast("long").alias("size"))


@query(f"SELECT conv_id, turn, md5(CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN contains(a, b) THEN a WHEN contains(b, a) THEN b ELSE coalesce({_clean('m')}, a) END) AS digest FROM (SELECT *, list_filter(list_transform(generate_series(least(length(a), length(b)), 8, -1), lambda k: CASE WHEN ends_with(a, substr(b, 1, k)) THEN a || substr(b, k + 1) WHEN ends_with(b, substr(a, 1, k)) THEN b || substr(a, k + 1) END), lambda x: x IS NOT NULL)[1] AS m FROM (SELECT conv_id, turn, {_clean('substr(text, 1, 60)')} AS a, {_clean('substr(text, (40 + conv_id % 30)::INT, 60)')} AS b FROM conversations WHERE text IS NOT NULL))")
def x12_merged_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", F.md5(C.merged_overlap(F.substring("text", 1, 60), F.expr("substring(text, CAST(40 + conv_id % 30 AS INT), 60)"))).alias("digest"))


_ENT = "l_orderkey AS k, CASE l_linenumber % 5 WHEN 0 THEN '的' WHEN 1 THEN 'x' WHEN 2 THEN ' ' WHEN 3 THEN 'widget' ELSE 'small' END AS entity, CASE WHEN l_linenumber = 6 THEN 'date' ELSE l_returnflag END AS category, CAST(l_partkey % 7 AS INT) AS start_pos, CAST(l_partkey % 7 + l_suppkey % 9 AS INT) AS end_pos, l_discount AS confidence, 'small widget' AS body"


@query(f"SELECT DISTINCT k, CASE WHEN start_pos < length(body) AND end_pos <= length(body) THEN substr(body, start_pos + 1, end_pos - start_pos) ELSE entity END AS entity, category, start_pos, end_pos, confidence FROM (SELECT *, row_number() OVER (PARTITION BY k, entity, start_pos, category ORDER BY confidence DESC, length(entity) DESC, end_pos) AS r FROM (SELECT {_ENT} FROM lineitem) WHERE trim(entity) <> '' AND (length(entity) >= 2 OR category = 'date') AND entity <> '的') WHERE r = 1")
def f16_kept_entities(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.expr("CASE l_linenumber % 5 WHEN 0 THEN '的' WHEN 1 THEN 'x' WHEN 2 THEN ' ' WHEN 3 THEN 'widget' ELSE 'small' END").alias("entity"), F.expr("CASE WHEN l_linenumber = 6 THEN 'date' ELSE l_returnflag END").alias("category"), F.expr("CAST(l_partkey % 7 AS INT)").alias("start_pos"), F.expr("CAST(l_partkey % 7 + l_suppkey % 9 AS INT)").alias("end_pos"), F.col("l_discount").alias("confidence"), F.lit("small widget").alias("body"))
    return N.kept_entities(e, "body", ["k"]).drop("body").distinct()


@query("SELECT o_custkey, COALESCE(nullif(o_orderpriority, '5-LOW'), 'unknown') AS category, count(*) AS n, md5(string_agg('N' || o_orderkey, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1, 2")
def g04_by_category(spark, sf_dir):
    e = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS category", "concat('N', o_orderkey) AS entity")
    return N.by_category(e, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "category", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",")).alias("digest"))


@query("SELECT c_mktsegment AS category, count(*) AS n, array_to_string(list_slice(list(c_name ORDER BY c_custkey), 1, 3), ',') AS samples FROM customer GROUP BY 1")
def g19_category_summary(spark, sf_dir):
    e = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS category", "c_name AS entity", "c_custkey")
    return N.category_summary(e, "c_custkey").withColumn("samples", F.array_join("samples", ","))


@query("SELECT c_name AS entity, COALESCE(o.t, c_mktsegment) AS category, COALESCE(o.p, c_acctbal) AS confidence, o.s AS standard_name FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS t, arg_max(o_totalprice, o_orderkey) AS p, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'N' || max(o_orderkey) END AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def j03_disambiguated_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name AS entity", "c_mktsegment AS category", "c_acctbal AS confidence")
    r = table(spark, sf_dir, "orders").join(c.selectExpr("c_custkey AS o_custkey", "entity"), "o_custkey").selectExpr("entity AS original_entity", "o_orderkey AS ordinal", "o_orderpriority AS type", "o_totalprice AS confidence", "CASE WHEN o_orderkey % 2 = 0 THEN concat('N', o_orderkey) ELSE '' END AS standard_name")
    return N.disambiguated_entities(c.drop("c_custkey"), r)


@query("SELECT count(*) AS resolved_count, count(*) FILTER (WHERE o_orderkey % 4 IN (1, 2)) AS standard_name_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS unknown_count, count(*) FILTER (WHERE o_orderkey % 100 < 60) AS low_confidence_count, round(avg(o_orderkey % 100 / 100.0), 2) AS average_confidence FROM orders")
def g21_disambiguation_summary(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr("concat('E', o_custkey) AS entity", "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 3 THEN concat('E', o_custkey) ELSE 'S' END AS standard_name", "CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'person' END AS type", "o_orderkey % 100 / 100.0D AS confidence")
    return N.disambiguation_summary(r)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS entity, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS start_pos, CASE WHEN p_size % 2 = 0 THEN p_size + length(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END) ELSE -1 END AS end_pos, CASE WHEN p_size % 5 = 0 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_type END AS category FROM part")
def z03_normalized_entities(spark, sf_dir):
    e = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS entity", "p_brand AS text", "p_type AS name", "CASE WHEN p_size % 2 = 0 THEN p_size END AS position", "CAST(NULL AS INT) AS start_pos", "CAST(NULL AS INT) AS end_pos", "CASE WHEN p_size % 5 <> 0 THEN 0.9D END AS confidence", "CASE WHEN p_size % 7 <> 0 THEN p_type END AS category")
    return N.normalized(e).fillna(-1, ["start_pos", "end_pos"])


@query("SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS documents_processed, count(*) AS entity_count, round(avg(o_orderkey % 100 / 100.0), 6) AS mean_confidence, 'document_review_needed' AS flags FROM orders")
def z05_batch_summary(spark, sf_dir):
    e = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 100 / 100.0D AS confidence", "o_orderstatus = 'P' AS needs_review")
    return N.batch_summary(e, table(spark, sf_dir, "customer"), "c_custkey").select("documents_processed", "entity_count", F.round("mean_confidence", 6).alias("mean_confidence"), F.array_join("quality_flags", ",").alias("flags"))


@query("SELECT doc_id, length(t) AS char_count, 3 AS expected, contains(t, 'tion')::BIGINT + contains(t, 'zzz')::BIGINT + contains(t, 'eau')::BIGINT AS found, 3 - (contains(t, 'tion')::BIGINT + contains(t, 'zzz')::BIGINT + contains(t, 'eau')::BIGINT) AS missing, (length(t) - length(replace(t, 'the', ''))) // 3 + (length(t) - length(replace(t, 'and', ''))) // 3 AS marker_hits FROM (SELECT doc_id, regexp_replace(text, '[\\s\\x0B]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL)")
def g23_name_evaluation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"])
    names = d.select("doc_id", F.explode(F.array(F.lit("tion"), F.lit("zzz"), F.lit("eau"))).alias("name"))
    return N.name_evaluation(d, names, "doc_id", "text", ["the", "and"]).withColumn("char_count", F.col("char_count").cast("long"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'tion', '[[tion]]'), 'the', '[[the]]'), 'on]]', chr(1)), 'on', '[[on]]'), chr(1), 'on]]')) AS digest FROM documents WHERE text IS NOT NULL")
def x11_linked_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(N.linked_text(F.col("text"), ["on", "the", "tion"])).alias("digest"))


@query("SELECT category, md5('## ' || category || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY s_suppkey)) AS digest FROM (SELECT 'n' || s_nationkey AS category, s_suppkey, '- **' || s_name || '**' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '  - 说明：a note' ELSE '' END || CASE WHEN s_suppkey % 10 > 0 THEN chr(10) || '  - 置信度：' || printf('%.2f', s_suppkey % 10 / 10.0) ELSE '' END || chr(10) || '  - 来源：s' AS item FROM supplier) GROUP BY category")
def k08_entity_notes(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('n', s_nationkey) AS category", "s_name AS entity", "CASE WHEN s_suppkey % 2 = 0 THEN 'a note' ELSE '' END AS notes", "s_suppkey % 10 / 10.0D AS confidence", "'s' AS source")
    return N.entity_notes(e, ["s_suppkey"]).select("category", F.md5("markdown").alias("digest"))


@query("SELECT o_orderkey AS \"offset\", 'source_mismatch' AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def f09_selected_items(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'source_mismatch' WHEN 'P' THEN 'source_not_found' ELSE 'matched' END").alias("status"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 = 0 ELSE o_orderkey % 3 = 0 END").alias("downloadable"))
    return S.selected_items(r, "source_mismatch", True).select("offset", "status")


@query("SELECT o_orderkey AS \"offset\" FROM orders WHERE o_orderstatus IN ('F', 'P')")
def f09_recheck_items(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'source_mismatch' WHEN 'P' THEN 'source_not_found' ELSE 'matched' END").alias("status"))
    return S.recheck_items(r).select("offset")


@query("SELECT source_rank, ordinal, score FROM (SELECT 0 AS source_rank, s_suppkey AS ordinal, s_acctbal AS score FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer) ORDER BY score DESC, source_rank, ordinal LIMIT 50")
def t_k5_merged_search(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ordinal", "s_acctbal AS score")
    return S.merged_search([s, table(spark, sf_dir, "customer").selectExpr("c_custkey AS ordinal", "c_acctbal AS score")], 50).select("source_rank", "ordinal", "score")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 50 BETWEEN 10 AND 20 OR o_orderkey % 30 BETWEEN 10 AND 20 THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS place FROM orders")
def t_k10_ordered_matches(spark, sf_dir):
    m = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderkey AS ordinal", "array(o_orderkey % 50, o_orderkey % 30) AS pages", "o_orderstatus = 'F' AS digital", "o_totalprice AS score")
    return S.ordered_matches(m, "o_custkey", F.lit(10), F.lit(20)).select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey, COALESCE(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END, 999999) AS place FROM orders")
def t_k14_result_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.result_order(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END"), F.expr("CASE WHEN o_orderkey % 3 = 1 THEN concat('p', o_custkey, '-f9') ELSE 'none' END")).alias("place"))


@query("SELECT candidate_id, o_orderkey, n - 1 AS duplicates, o_custkey AS order_key FROM (SELECT 'p' || o_custkey AS candidate_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1")
def u06_merged_payloads(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 4 AS payload", "o_orderkey AS ordinal", "concat('p', o_custkey) AS candidate_id", "CAST(NULL AS LONG) AS refinement")
    return S.merged_payloads(r).select("candidate_id", F.col("ordinal").alias("o_orderkey"), "duplicates", "order_key")


@query("SELECT o_custkey, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def t_k15_experiences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("start", F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), "start"))).alias("e"))
    ordered = S.experiences_by_start(F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["key"].alias("key"))))
    return lists.select("o_custkey", F.md5(F.array_join(F.transform(ordered, lambda x: x["key"].cast("string")), ",")).alias("digest"))


@query("SELECT unnest(['total_candidates', 'processed_candidates', 'remaining_candidates', 'source_found', 'llm:eligible_for_llm_review', 'llm:llm_review_success']) AS measure, unnest([100, count(*), greatest(100 - count(*), 0), count(*) FILTER (WHERE o_orderkey % 3 > 0), count(*) FILTER (WHERE o_orderkey % 2 = 0), count(*) FILTER (WHERE o_orderkey % 4 = 0)]) AS n FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE o_orderstatus END, count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'support:' || CASE WHEN o_orderkey % 5 = 0 THEN 'unassessed' ELSE o_orderpriority END, count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'refined:' || o_orderpriority, count(*) FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1")
def g15_checkpoint_summary(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS support_status", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS refined_status", "o_orderkey % 3 AS matches", "o_orderkey % 2 = 0 AS eligible_for_llm_review", "o_orderkey % 4 = 0 AS llm_review_success", "false AS llm_review_json_repaired", "false AS llm_review_fallback_heuristic", "false AS llm_review_failed")
    return S.checkpoint_summary(r, 100)


@query("SELECT 'total' AS kind, '' AS name, count(*) AS n FROM orders UNION ALL SELECT 'type', COALESCE(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'unknown'), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'stage', 'stage' || o_orderkey % 5, count(*) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2")
def g17_artifact_summary(spark, sf_dir):
    a = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS type", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS stage")
    return S.artifact_summary(a)


@query("SELECT count(*) AS review_queue_count, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS open_review_count FROM orders")
def g17_open_reviews(spark, sf_dir):
    return S.open_reviews(table(spark, sf_dir, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'done' END AS status"))


@query("SELECT l_orderkey, COALESCE(round(avg(CASE WHEN l_linenumber > 2 THEN l_discount END), 6), 0.0) AS confidence FROM lineitem GROUP BY 1")
def g02_mean_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_linenumber > 2 THEN l_discount END AS score")
    return S.mean_score(rows, "l_orderkey").withColumn("confidence", F.round("confidence", 6))


@query("SELECT p_partkey, round(p_size / 100.0 + CASE WHEN p_size % 2 = 0 THEN 0.7 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.12 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.3 ELSE 0 END, 6) AS score FROM part")
def z09_effective_score(spark, sf_dir):
    n = F.col("p_size")
    value = S.effective_score(n / 100, n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 7 == 0, F.lit(0.2))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 6).alias("score"))


@query("SELECT p_partkey, round(greatest(CASE WHEN contains(p_name, 'widget') THEN 0.45 ELSE 0 END + CASE WHEN contains(p_type, 'ECO') THEN 0.2 ELSE 0 END + CASE WHEN contains(p_name, 'small') THEN 0.3 ELSE 0 END, CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0 END + CASE WHEN p_brand = 'Brand#13' THEN 0.15 ELSE 0 END), 6) AS specificity FROM part")
def z10_hint_specificity(spark, sf_dir):
    hints = F.array(F.struct(F.col("p_name").alias("query"), F.col("p_type").alias("snippet"), F.lit(False).alias("has_page")), F.struct(F.lit("").alias("query"), F.when(F.col("p_brand") == "Brand#13", "Brand#13").otherwise("-").alias("snippet"), (F.col("p_size") % 2 == 0).alias("has_page")))
    value = S.hint_specificity(hints, F.lit("widget"), F.lit("ECO"), F.lit("Brand#13"), F.array(F.lit("small"), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 6).alias("specificity"))


@query("SELECT p_partkey, CASE WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN 0 WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 1 WHEN p_size % 5 = 0 AND p_size % 3 = 1 THEN 2 WHEN p_size % 3 = 0 THEN 4 ELSE 3 END AS priority FROM part")
def z11_source_priority(spark, sf_dir):
    n = F.col("p_size")
    routes = F.when(n % 3 == 0, F.array(F.lit("html_fulltext"))).when(n % 3 == 1, F.array(F.lit("digital_fulltext"))).otherwise(F.array(F.lit("catalogue")))
    return table(spark, sf_dir, "part").select("p_partkey", S.source_priority(n % 11 == 0, n % 13 == 0, n % 2 == 0, n % 5 == 0, routes).alias("priority"))


@query("SELECT o_orderkey, md5(o_custkey || chr(31) || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END || chr(31) || o_orderpriority) AS digest FROM orders")
def m08_deduplication_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.md5(S.deduplication_key([F.col("o_custkey"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END"), F.col("o_orderpriority")])).alias("digest"))


@query("SELECT o_orderkey, o_orderpriority AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'right' ELSE o_orderstatus END AS b FROM orders")
def m04_merged_maps(spark, sf_dir):
    right = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("right")))
    m = S.merged_maps(F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("b"), F.col("o_orderstatus")), right)
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0.0 WHEN regexp_replace(text, '[\\s\\x0B]+', '', 'g') = '' THEN least(0.2, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, COALESCE(lang <> 'en', true) OR text IS NULL OR regexp_replace(text, '[\\s\\x0B]+', '', 'g') = '' AS needs_review FROM documents")
def m09_validated_output(spark, sf_dir):
    v = S.validated_output(F.col("text"), F.coalesce(F.col("lang") == "en", F.lit(False)))
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.confidence", "v.needs_review")


@query("WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value AS y, event_type AS t, (event_id % 12 + 6)::DOUBLE AS size FROM events), r AS (SELECT user_id, k, y AS y0, 0 AS line FROM l WHERE k = 1 UNION ALL SELECT l.user_id, l.k, CASE WHEN abs(r.y0 - l.y) <= 40 THEN r.y0 ELSE l.y END, CASE WHEN abs(r.y0 - l.y) <= 40 THEN r.line ELSE r.line + 1 END FROM r JOIN l ON l.user_id = r.user_id AND l.k = r.k + 1) SELECT user_id, line AS row, md5(string_agg(t, '' ORDER BY k)) AS digest, round(sum(size * length(t)) / greatest(sum(length(t)), 1), 6) AS size FROM r JOIN l USING (user_id, k) GROUP BY 1, 2")
def g30_merged_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS ordinal", "value AS y", "event_type AS text", "CAST(event_id % 12 + 6 AS DOUBLE) AS size")
    return S.merged_rows(e, "user_id", 40.0).select("user_id", "row", F.md5("text").alias("digest"), F.round("size", 6).alias("size"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(regexp_replace(text, '[\\s\\x0B　]+', ' ', 'g'), '　', ' '), '[^\\p{L}\\p{N}_\\s\\x0B]', '', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def x02_cleaned_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(X.cleaned_text(F.col("text"), special=True)).alias("digest"))


@query("SELECT doc_id, md5(trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, ',', ' ,'), ' ,', ','), ' .', '.'), ' , ', ', '), ' . ', '. '), '  ', ' '), '— ', '—'), '「 ', '「'), ' 」', '」'))) AS digest FROM documents WHERE text IS NOT NULL")
def x04_lightly_corrected(spark, sf_dir):
    """Texts with a space put before every comma."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(X.lightly_corrected(F.replace("text", F.lit(","), F.lit(" ,")))).alias("digest"))


_STAMP = "'E' || (100000000 + doc_id) || ' 2024/01/02  03:04:05 SAMPLE ' || text"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STAMP}, 'sample', '', 'gi'), 'E\\d{{8,}}', '', 'g'), '\\d{{4}}/\\d{{2}}/\\d{{2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}', '', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def x06_without_watermarks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    stamped = F.concat(F.lit("E"), (F.lit(100000000) + F.col("doc_id")).cast("string"), F.lit(" 2024/01/02  03:04:05 SAMPLE "), "text")
    return d.select("doc_id", F.md5(X.without_watermarks(stamped, ["sample"])).alias("digest"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '```(html)?\\s*', '', 'g'), '<p[^>]*>|<br\\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages WHERE html IS NOT NULL")
def x06_without_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.md5(X.without_tags(F.col("html"))).alias("digest"))


@query("SELECT p_partkey, regexp_replace(translate(lower('『' || p_name || '』國會 ' || p_brand), '國會學條關說卷册·', '国会学条関説巻冊・'), '[\\s　「」『』《》〈〉（）()\\[\\]［］・･·,，.。:：;；、\\-‐‑–—_/]+', '', 'g') AS source_key, regexp_replace(translate('『' || p_name || '』國會 ' || p_brand, '關說會舊國圖學', '関説会旧国図学'), '[\\s　『』「」《》〈〉（）()［］\\[\\]・,，.。:：;；、\\-ー―—_/]+', '', 'g') AS lookup_title, regexp_replace(lower('『' || p_name || '』國會 ' || p_brand), '[\\s　「」『』《》〈〉（）()［］\\[\\]、，,。．.・·:：；;]+', '', 'g') AS alias_key FROM part")
def x08_search_keys(spark, sf_dir):
    t = F.concat(F.lit("『"), "p_name", F.lit("』國會 "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", X.source_key(t).alias("source_key"), X.lookup_title(t).alias("lookup_title"), X.alias_key(t).alias("alias_key"))


@query("SELECT doc_id, count(*) AS token_count, array_to_string(list_slice(list(word || ':' || n ORDER BY n DESC, pos) FILTER (WHERE fresh AND length(word) >= 2), 1, 10), ',') AS terms FROM (SELECT doc_id, word, pos, count(*) OVER (PARTITION BY doc_id, word) AS n, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) = 1 AS fresh FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']+|[一-鿿]{2,}') AS w FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id")
def g10_term_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["n"].cast("string"))), ",")
    return U.term_profile(d, "doc_id", X.style_tokens(F.col("text"))).withColumn("terms", terms)


_MARKDOWN = "'# ' || p_name || chr(10) || 'see # ' || p_name || chr(10) || '## ' || p_type || chr(10) || 'body' || chr(10) || '### ' || p_name"


@query("SELECT p_partkey, '1:' || p_name || ':0|2:' || p_type || ':' || (10 + 2 * length(p_name)) || '|3:' || p_name || ':' || (10 + 2 * length(p_name) + 4 + length(p_type) + 5) AS outline FROM part")
def s12_outline(spark, sf_dir):
    found = X.outline(F.expr(_MARKDOWN))
    line = F.array_join(F.transform(found, lambda h: F.concat_ws(":", h["level"].cast("string"), h["title"], h["position"].cast("string"))), "|")
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("outline"))


_KEYS = ["therefore", "the", "tion", "and"]


@query(f"WITH s AS (SELECT doc_id, text, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS place, len(l) AS n FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), lambda x: length(x) > 0) AS l FROM documents WHERE text IS NOT NULL)), c AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM documents) WHERE length(word) > 1 GROUP BY 1, 2), f AS (SELECT w.doc_id, place, COALESCE(sum(times), 0) / (count(*) * 2) AS f FROM (SELECT doc_id, place, unnest(regexp_extract_all(lower(sentence), '\\w+')) AS word FROM s) w LEFT JOIN c ON c.doc_id = w.doc_id AND c.word = w.word GROUP BY 1, 2) SELECT s.doc_id, s.place, round(0.25 * CASE WHEN s.place < 3 THEN 1.0 WHEN s.place < n * 0.2 THEN 0.8 WHEN s.place > n * 0.8 THEN 0.7 ELSE 0.5 END + 0.35 * least(1.0, {' + '.join(f'0.2 * contains(lower(sentence), {chr(39)}{k}{chr(39)})::INT' for k in _KEYS)}) + 0.15 * CASE WHEN length(sentence) BETWEEN 50 AND 200 THEN 1.0 WHEN length(sentence) BETWEEN 30 AND 300 THEN 0.7 ELSE 0.4 END + 0.25 * least(1.0, COALESCE(f, 0.0)), 9) AS score FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.place = s.place")
def r21_sentence_importance(spark, sf_dir):
    return U.sentence_importance(table(spark, sf_dir, "documents"), "doc_id", "text", _KEYS).select("doc_id", "place", F.round("score", 9).alias("score"))
