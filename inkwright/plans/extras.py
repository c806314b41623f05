"""Queries for small text functions, predicates, records of runs and file formats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as V
from ..operators import extraction as E
from ..operators import records as R
from ..operators import retrieval as Q
from ..operators import runs as N
from ..operators import selection as S
from ..operators import summaries as U
from ..sources import readers, writers
from .files import _put, place
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
    return f"trim(regexp_replace({x}, '[\\s\\x0B 　]+', ' ', 'g'))"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL")


@query(f"SELECT doc_id, md5({_clean('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def x01_collapse(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@query("SELECT doc_id, substr(text, greatest(instr(text, 'tion') - 90, 1), 4 + 90 + least(instr(text, 'tion') - 1, 90)) AS snippet FROM documents WHERE instr(text, 'tion') > 0")
def x09_snippet(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), F.lit("tion")).alias("snippet")).filter("snippet IS NOT NULL")


@query(f"SELECT doc_id, md5(CASE WHEN length(c) <= 700 THEN c ELSE rtrim(substr(c, 1, 700)) || '...' END) AS digest FROM (SELECT doc_id, {_clean('text')} AS c FROM documents WHERE text IS NOT NULL)")
def x13_truncated(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.truncated(F.col("text"))).alias("digest"))


@query("SELECT page_id, substr(trim(regexp_replace(url, '[\\\\/:*?\"<>|\\x00-\\x1f]', '_', 'g')), 1, 100) AS name FROM pages")
def x16_safe_file_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("name"))


@query("SELECT conv_id, turn, substr(md5(conv_id || ':' || turn || ':' || substr(text, 1, 50)), 1, 16) AS chunk_id FROM conversations WHERE text IS NOT NULL")
def m06_chunk_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", T.chunk_id(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")).alias("chunk_id"))


@query("SELECT p_partkey, p_size / 100.0 >= 0.35 OR p_size % 7 = 0 AS plausible FROM part")
def f11_plausible(spark, sf_dir):
    title = F.when(F.col("p_size") % 7 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.plausible(F.col("p_size") / 100, title).alias("plausible"))


@query("SELECT o_orderkey, (o_orderkey % 3 = 0 OR o_orderkey % 4 = o_custkey % 4) AND (o_orderkey % 5 = 0 OR o_orderkey % 6 = o_custkey % 6) AS same FROM orders")
def f12_same_place(spark, sf_dir):
    same = R.same_place(F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END"), F.expr("o_orderkey % 6"), F.expr("o_custkey % 4"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 6 END"))
    return table(spark, sf_dir, "orders").select("o_orderkey", same.alias("same"))


@query("SELECT p_partkey, round(greatest(0.1, least(CASE WHEN p_size % 5 = 0 THEN least(v, 0.68) ELSE v END, 0.95)), 2) AS confidence FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 0.72 ELSE 0.2 END ELSE p_size / 50.0 END AS v FROM part)")
def g26_ocr_confidence(spark, sf_dir):
    n = F.col("p_size")
    value = R.ocr_confidence(F.when(n % 3 != 0, n / 50), n % 2 == 0, n % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("confidence"))


_HAN, _KANA = "length(regexp_replace(text, '[^一-鿿]', '', 'g')) / greatest(length(text), 1)", "length(regexp_replace(text, '[^぀-ヿ]', '', 'g')) / greatest(length(text), 1)"


_SHARE = "(len(regexp_extract_all(text, '[{}]')) / length(text))"
_READING = "concat(translate(replace(text, '(', ''), CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'aeiou' WHEN 2 THEN 'aeiou' WHEN 3 THEN 'eotn' ELSE 'etah' END, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'あいうえお' WHEN 2 THEN '一二三四五' WHEN 3 THEN 'あ二ソ' ELSE 'え一三ハ' END), repeat('《x》', CAST(doc_id % 13 AS INT)))"


@query(f"SELECT doc_id, greatest(1, length(text) // 400)::INT AS minutes, CASE WHEN length(text) = 0 THEN 'unknown' WHEN {_SHARE.format('一-鿿')} > 0.3 THEN 'chinese' WHEN {_SHARE.format('぀-ヿ')} > 0.2 THEN 'japanese' WHEN {_SHARE.format('一-鿿')} > 0.1 AND {_SHARE.format('぀-ヿ')} > 0.1 THEN 'mixed_cjk' ELSE 'other' END AS language, CASE WHEN doc_id % 13 > 10 THEN 'difficult' WHEN doc_id % 13 > 5 THEN 'medium' ELSE 'easy' END AS difficulty FROM (SELECT doc_id, {_READING} AS text FROM documents WHERE text IS NOT NULL)")
def z08_reading(spark, sf_dir):
    """Whole texts, two thirds of them with kana or Han characters for some letters, and some terms."""
    d = _documents(spark, sf_dir).select("doc_id", F.expr(_READING).alias("text"))
    return d.select("doc_id", U.reading_minutes(F.col("text")).alias("minutes"), T.reading_language(F.col("text")).alias("language"), U.reading_difficulty(F.col("text")).alias("difficulty"))


@query("SELECT doc_id, bucket, array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS terms FROM documents, (VALUES ('who', ['tion', 'zzz'], ['a', 'b']), ('who', ['eau'], ['b', 'c']), ('when', ['the '], ['d'])) r(bucket, triggers, terms) WHERE len(list_filter(triggers, lambda t: contains(text, t))) > 0 GROUP BY doc_id, bucket")
def z18_active_facets(spark, sf_dir):
    rules = spark.createDataFrame([("who", ["tion", "zzz"], ["a", "b"]), ("who", ["eau"], ["b", "c"]), ("when", ["the "], ["d"])], "bucket string, triggers array<string>, terms array<string>")
    claims = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("claim"))
    return R.active_facets(claims, rules).select(F.col("id").alias("doc_id"), "bucket", F.array_join("terms", ",").alias("terms"))


@query("SELECT conv_id AS doc_id, turn AS sentence, entity AS \"left\", nxt AS \"right\" FROM (SELECT conv_id, turn, entity, lead(entity) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS nxt FROM conversations, (VALUES (1, 'tion'), (2, 'eau'), (3, 'the'), (4, 'ing')) e(ord, entity) WHERE contains(text, entity)) WHERE nxt IS NOT NULL")
def z01_co_occurrences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence"), "text")
    entities = c.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, ("tion", "eau", "the", "ing")))).alias("ord", "entity"))
    return E.co_occurrences(c, entities)


@query("SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 0.2 ELSE round(greatest(0.1, least(0.45 + CASE WHEN p_size % 2 > 0 THEN 0.25 ELSE 0 END + CASE WHEN p_size % 3 > 0 THEN 0.1 ELSE 0 END + least(0.15, p_size / 37.0 * 0.15) - least(0.25, p_size % 5 * 0.08), 0.95)), 2) END AS confidence FROM part")
def m02_package_confidence(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.package_confidence(n % 11, n % 2, n % 3, n / 37, n % 5).alias("confidence"))


@query("SELECT DISTINCT o_orderkey AS package_id, unnest([o_orderstatus, o_orderpriority, o_orderstatus]) AS flag FROM orders")
def p04_review_queue(spark, sf_dir):
    return N.review_queue(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"), F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("quality_flags")))


@query("SELECT conv_id, md5(string_agg('[t' || turn || '] ' || substr(text, 1, 300), chr(10) || chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL) WHERE r <= 3 GROUP BY conv_id")
def r16_basic_answer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    answer = Q.basic_answer(F.transform("l", lambda x: x["text"]), F.transform("l", lambda x: F.concat(F.lit("t"), x["turn"].cast("string"))))
    return lists.select("conv_id", F.md5(answer).alias("digest"))


@query("SELECT event_id, (event_id % 50) / 50.0 - (event_id % 30) / 60.0 > 0.15 AND (event_id % 50) / 50.0 >= 0.3 AND event_id % 3 <= 1 AND (event_id % 30) / 60.0 < 0.2 AS promoted FROM events")
def r26_context_promotion(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", V.context_promotion((i % 30) / 60, (i % 50) / 50, i % 3).alias("promoted"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def k05_export_json(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.export_json(rows, path := place(spark, "json"))
    return spark.read.schema(rows.schema).json(path)


@query("SELECT '{\"o_orderkey\":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',\"phase\":\"' || o_orderstatus || '\"' ELSE '' END || '}' AS value FROM orders")
def k16_append_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS phase")
    writers.append_progress(rows, path := place(spark, "progress"))
    return spark.read.text(path)


@query("SELECT p_partkey, 'name' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'url', 'x:y' FROM part")
def e09_key_values(spark, sf_dir):
    text = F.expr("concat('name: ', p_name, '\\n  brand ： ', p_brand, '  \\nno pair here\\nurl:x:y')")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(E.key_values(text)).alias("k")).select("p_partkey", "k.*")


def _shape(text: str) -> str:
    lengths = f"list_filter(list_transform(regexp_extract_all({text}, '[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+'), lambda s: length(regexp_replace(s, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'))), lambda n: n > 0)"
    return f"(SELECT {{'m': coalesce(list_sum(l), 0) / greatest(len(l), 1), 'a': len(list_filter(l, lambda n: n >= 60)) / greatest(len(l), 1), 'b': len(list_filter(l, lambda n: n <= 20)) / greatest(len(l), 1), 'c': ((length({text}) - length(replace({text}, 'and', ''))) // 3) / greatest(len(l), 1)}} FROM (SELECT {lengths} AS l))"


@query(f"SELECT conv_id, turn, round((abs(x.m - y.m) / 100 + abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c)) / 4, 6) AS distance FROM (SELECT conv_id, turn, {_shape('text')} AS x, {_shape('head')} AS y FROM (SELECT conv_id, turn, text, substr(text, 1, 150) AS head FROM conversations WHERE text IS NOT NULL))")
def e21_style_distance(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    shapes = c.select("conv_id", "turn", U.sentence_shape(F.col("text"), ["and"]).alias("x"), U.sentence_shape(F.substring("text", 1, 150), ["and"]).alias("y"))
    return shapes.select("conv_id", "turn", F.round(U.style_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query("SELECT p_partkey, 0 AS section, 0 AS level, md5('before') AS digest FROM part UNION ALL SELECT p_partkey, 1, 1, md5('# ' || p_name || chr(10) || 'body ' || p_size) FROM part UNION ALL SELECT p_partkey, 2, 3, md5('### ' || p_type || chr(10) || 'more' || chr(10)) FROM part")
def w13_section_bodies(spark, sf_dir):
    text = F.expr("concat('before\\n# ', p_name, '\\nbody ', p_size, '\\n### ', p_type, '\\nmore\\n')")
    s = E.headings(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return s.select("p_partkey", F.col("section").cast("int").alias("section"), "level", F.md5("content").alias("digest"))


@query("SELECT vec_id AS chunk_id, vec_id % 50 AS document_id FROM embeddings WHERE vec_id % 50 = 3")
def f17_stored_ids(spark, sf_dir):
    return S.stored_ids(table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "vec_id % 50 AS document_id"), 3)


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE vec_id % 50 END AS document_id FROM embeddings UNION ALL SELECT -1, -1")
def r12_stored_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "vec_id % 50 AS document_id")
    new = old.filter("chunk_id % 4 = 0").selectExpr("chunk_id", "-1L AS document_id").unionByName(spark.range(1).selectExpr("-1L AS chunk_id", "-1L AS document_id"))
    return S.stored_upsert(old, new)


@query("SELECT DISTINCT p_partkey, host FROM part, (VALUES ('widget', 'h1'), ('small widget and more', 'h2'), ('rod', 'h1'), ('', 'h3')) r(c, host) WHERE c <> '' AND (contains(p_name, c) OR contains(c, p_name))")
def j14_host_titles(spark, sf_dir):
    hosts = spark.createDataFrame([("widget", "h1"), ("small widget and more", "h2"), ("rod", "h1"), ("", "h3")], "contained string, host string")
    return S.host_titles(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS title"), hosts, "p_partkey")


@query("SELECT conv_id, turn // 2 AS \"group\", min(turn) AS \"first\", max(turn) AS \"last\", md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn // 2")
def t10_page_groups(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").selectExpr("conv_id", "turn AS page", "text")
    return S.page_groups(pages, "conv_id", 2).select("conv_id", "group", "first", "last", F.md5("text").alias("digest"))


@query("SELECT conv_id, count(*) AS pages, sum(len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')))::BIGINT AS words, sum(length(text))::BIGINT AS characters FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def g22_text_totals(spark, sf_dir):
    return S.text_totals(table(spark, sf_dir, "conversations").filter("text IS NOT NULL"), "conv_id")


@query("SELECT 'speeches' AS measure, '' AS name, count(*) AS n FROM orders UNION ALL SELECT 'kind', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'speaker', 'c' || o_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 > 0 GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)")
def g12_speech_statistics(spark, sf_dir):
    return S.speech_statistics(table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS kind", "CASE WHEN o_custkey % 3 > 0 THEN concat('c', o_custkey) ELSE '' END AS speaker"))


@query("SELECT o_custkey AS run, count(*) AS expected, count(*) FILTER (WHERE o_orderkey % 5 > 0) AS done, count(*) = count(*) FILTER (WHERE o_orderkey % 5 > 0) AS complete FROM orders GROUP BY 1")
def t06_partial_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "o_orderkey AS id")
    return S.partial_progress(o.filter("id % 5 > 0"), o)


def _nations(spark, sf_dir):
    return [(r["n_nationkey"], r["n_name"]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]


@query("SELECT 'b' || (n_nationkey % 5) AS block, n_nationkey AS line, n_nationkey * 2.0 AS x, n_name AS text, 0.5 AS confidence FROM nation")
def s21_ocr_xml(spark, sf_dir):
    lines = {}
    for key, name in _nations(spark, sf_dir):
        lines.setdefault(key % 5, []).append(f'<LINE ORDER="{key}" X="{key * 2}" Y="0" WIDTH="9" HEIGHT="3" STRING="{name}" CONF="0.5"/>')
    body = "".join(f'<TEXTBLOCK ID="b{k}">{"".join(v)}</TEXTBLOCK>' for k, v in lines.items())
    _put(spark, f"{(path := place(spark, 'ocr'))}/page.xml", f"<OCRDATASET><PAGE>{body}</PAGE></OCRDATASET>")
    return readers.ocr_xml(spark, path).select("block", "line", "x", "text", "confidence")


@query("SELECT n_nationkey AS page, n_name || chr(10) || 'line' AS text, k AS kind FROM nation, (VALUES ('json'), ('csv')) t(k) UNION ALL SELECT n_nationkey + 1, n_name, 'text' FROM nation")
def s22_ocr_pages(spark, sf_dir):
    nations, path = _nations(spark, sf_dir), place(spark, "pages")
    _put(spark, f"{path}/a/pages.json", json.dumps([{"page": k, "text": f"{n}\nline"} for k, n in nations]))
    _put(spark, f"{path}/b/pages.csv", "page,text\n" + "".join(f'{k},"{n}\nline"\n' for k, n in nations))
    _put(spark, f"{path}/c/pages.txt", "\f".join(n for _, n in sorted(nations)))
    found = [readers.ocr_pages(spark, f"{path}/{folder}", kind).select("page", "text", F.lit(kind).alias("kind")) for folder, kind in (("a", "json"), ("b", "csv"), ("c", "text"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT (1000 + n_nationkey)::VARCHAR AS id, n_nationkey AS c_start, n_nationkey + 3 AS c_stop FROM nation")
def s23_download_index(spark, sf_dir):
    path = place(spark, "downloads")
    for key, _ in _nations(spark, sf_dir):
        _put(spark, f"{path}/ndl_{1000 + key}_p{key}-p{key + 3}.pdf", "x")
    _put(spark, f"{path}/other.pdf", "x")
    return readers.download_index(spark, path).select("id", "c_start", "c_stop")


@query("SELECT 'r' || n_regionkey AS category, 'about' AS description, n_name AS entity FROM nation")
def s24_entity_dictionary(spark, sf_dir):
    groups = {}
    for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_name").collect():
        groups.setdefault(f"r{r['n_regionkey']}", {"description": "about", "entities": []})["entities"].append(r["n_name"])
    _put(spark, f"{(path := place(spark, 'dictionary'))}/d.json", json.dumps({"categories": groups}))
    return readers.entity_dictionary(spark, path)
