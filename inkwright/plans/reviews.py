"""Queries for search terms, rule entities, reviews and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleanup as X
from ..functions import dates as D
from ..operators import evidence as V
from ..operators import extraction as E
from ..operators import selection as S
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


def _once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_TITLE = "concat(p_name, '：国会', p_brand, '・の/', p_type, CASE WHEN p_size % 3 = 0 THEN ' - 學史' ELSE '' END)"


def _nonempty(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda q: {_clean('q')}), lambda q: q <> '')"


@query(f"SELECT p_partkey, array_to_string(list_slice({_once('a')}, 1, 6), '|') AS terms FROM (SELECT p_partkey, list_concat(flatten(list_transform({_nonempty(f'regexp_split_to_array(t, {chr(39)}[：:—-]{chr(39)})')}, lambda p: list_concat([p], {_nonempty(f'regexp_split_to_array(p, {chr(39)}[のと・／/]{chr(39)})')}))), regexp_extract_all(t, '[぀-ヿ㐀-鿿A-Za-z0-9]{{2,}}')) AS a FROM (SELECT p_partkey, {_TITLE} AS t FROM part))")
def x14_title_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.title_terms(F.expr(_TITLE)), "|").alias("terms"))


@query("SELECT p_partkey, 'A ' || p_brand || '|B' AS authors FROM part")
def x14_author_terms(spark, sf_dir):
    author = F.concat(F.lit(" A  "), "p_brand", F.lit("、B;  , C"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.author_terms(author), "|").alias("authors"))


_FORMS = f"list_filter(list_concat([c, {_clean(chr(39).join(['regexp_replace(c, ', '[・·／/、，,;；]+', ', ', ' ', ', ', 'g', ')']))}, regexp_replace(c, '[\\s　・·／/、，,;；]+', '', 'g')], list_transform(regexp_split_to_array(c, '[・·／/、，,;；]+'), lambda q: {_clean('q')})), lambda v: v <> '')"


@query(f"SELECT p_partkey, array_to_string(list_slice({_once('a')}, 1, 10), '|') AS variants FROM (SELECT p_partkey, list_concat(f, flatten(list_transform(f, lambda v: [translate(v, '国条体学会', '國條體學會'), translate(v, '國條體學會', '国条体学会')]))) AS a FROM (SELECT p_partkey, {_once('f0')} AS f FROM (SELECT p_partkey, {_FORMS} AS f0 FROM (SELECT p_partkey, {_clean(_TITLE)} AS c FROM part))))")
def x14_title_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.title_variants(F.expr(_TITLE)), "|").alias("variants"))


_DAYS = "concat('記 ', CASE p_size % 3 WHEN 0 THEN '明治三十年' WHEN 1 THEN concat('大正', 1 + p_size % 15, '年') ELSE '昭和九年' END, ' ', 1 + p_size % 12, '月 ', 1 + p_size % 28, '日、 四月 二日')"


@query("SELECT p_partkey, unnest([4, 1 + p_size % 12])::INT AS month, unnest([2, 1 + p_size % 28])::INT AS day, CASE p_size % 3 WHEN 0 THEN 1897 ELSE 1912 + p_size % 15 END::INT AS year FROM part WHERE p_size % 3 < 2")
def d03_dated_days(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(D.dated_days(F.expr(_DAYS))).alias("d")).select("p_partkey", "d.*")


_HAN = "concat('p', p_size, ' 山田氏 and 東京都 in ', 1800 + p_size, '年', 1 + p_size % 12, '月, 明治', 1 + p_size % 9, '年')"


@query("SELECT p_partkey, unnest(e).e AS entity, unnest(e).c AS category, (instr(t, unnest(e).e) - 1)::INT AS start, unnest(e).x AS confidence FROM (SELECT p_partkey, t, [{'e': '山田氏', 'c': 'person', 'x': 0.4::DOUBLE}, {'e': '東京都', 'c': 'person', 'x': 0.4::DOUBLE}, {'e': '明治', 'c': 'person', 'x': 0.4::DOUBLE}, {'e': '東京都', 'c': 'location', 'x': 0.45::DOUBLE}, {'e': (1800 + p_size) || '年' || (1 + p_size % 12) || '月', 'c': 'date', 'x': 0.7::DOUBLE}, {'e': '明治' || (1 + p_size % 9) || '年', 'c': 'date', 'x': 0.7::DOUBLE}] AS e FROM (SELECT p_partkey, p_size, " + _HAN + " AS t FROM part))")
def z04_rule_entities(spark, sf_dir):
    return E.rule_entities(table(spark, sf_dir, "part").select("p_partkey", F.expr(_HAN).alias("t")), "p_partkey", "t")


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'by ' || p_type END AS author, '' AS isbn FROM part")
def e23_first_fields(spark, sf_dir):
    text = F.expr("concat('Title: ', p_name, '  \\n', CASE WHEN p_size % 2 = 0 THEN concat('AUTHOR = ', p_brand) ELSE concat('Writer: by ', p_type) END, '\\nend')")
    fields = E.first_fields(text, {"title": ["^title: (.+)$"], "author": ["^author = (.+)$", "^writer: (.+)$"], "isbn": [r"isbn (\d+)"]})
    return table(spark, sf_dir, "part").select("p_partkey", fields.alias("f")).select("p_partkey", "f.*")


@query("SELECT p_partkey, 1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def z37_evidence_count(spark, sf_dir):
    reply = F.expr("""concat('{"a": [{"evidence_text": "', p_name, '"}, {"evidence_text": ""}], "b": {"evidence_text": ', CASE WHEN p_size % 2 = 0 THEN '"x"' ELSE 'null' END, ', "c": {"evidence_text" : []}}}')""")
    return table(spark, sf_dir, "part").select("p_partkey", E.evidence_count(reply).alias("n"))


@query("SELECT doc_id, m AS citation_markers, array_to_string(list_filter([CASE WHEN length(text) < 2000 THEN 'draft_short' END, CASE WHEN s < 3 THEN 'section_structure_weak' END, CASE WHEN m = 0 THEN 'no_citation_markers' END], lambda x: x IS NOT NULL), ',') AS flags, round(least(0.98, 0.45 + CASE WHEN length(text) >= 2000 THEN 0.2 ELSE 0 END + CASE WHEN s >= 3 THEN 0.2 ELSE 0 END + CASE WHEN m > 0 THEN 0.1 ELSE 0 END + CASE WHEN length(text) >= 2000 AND s >= 3 AND m > 0 THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence FROM (SELECT doc_id, text, doc_id % 5 AS s, (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END)::INT AS m FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [1,2] (Smith, 1990)' ELSE text END AS text FROM (SELECT doc_id, regexp_replace(text, '[\\[\\]()]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)))")
def z36_draft_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[\[\]()]", "").alias("text"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" [1,2] (Smith, 1990)"))).otherwise(F.col("text"))
    q = d.select("doc_id", E.draft_quality(text, F.col("doc_id") % 5, 4).alias("q")).select("doc_id", "q.*")
    return q.withColumn("flags", F.array_join("flags", ","))


_CONTEXT = "o_custkey, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'direct_support' WHEN 1 THEN 'partial_support' WHEN 2 THEN 'not_supported' ELSE 'uncertain' END AS decision, (o_orderkey % 7) / 8.0{d} AS confidence, (o_orderkey * 13 % 160) / 8.0{d} AS score, o_orderkey % 3 > 0 AS body, o_orderkey % 5 > 2 AS core"


@query(f"SELECT o_custkey, ordinal AS context_id, decision, confidence, combined FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY combined DESC, ordinal) AS r FROM (SELECT *, CASE decision WHEN 'direct_support' THEN 300.0 WHEN 'partial_support' THEN 200.0 WHEN 'uncertain' THEN 100.0 ELSE 0.0 END::DOUBLE + confidence * 10.0::DOUBLE + score AS combined FROM (SELECT o_custkey, ordinal, score, CASE WHEN body AND core AND score >= 10 THEN 'direct_support' WHEN body AND score >= 7 AND decision = 'not_supported' THEN 'partial_support' ELSE decision END AS decision, CASE WHEN body AND core AND score >= 10 THEN round(least(0.92, greatest(0.72, score / 18)), 4) WHEN body AND score >= 7 AND decision = 'not_supported' THEN round(least(0.78, greatest(0.45, score / 18)), 4) ELSE confidence END AS confidence FROM (SELECT {_CONTEXT.format(d='::DOUBLE')} FROM orders)))) WHERE r = 1")
def r28_reviewed_contexts(spark, sf_dir):
    from_orders = [c.strip() for c in _CONTEXT.format(d="D").replace("'direct_support' WHEN", "'direct_support' WHEN").split(", ")]
    return V.reviewed_contexts(table(spark, sf_dir, "orders").selectExpr(*from_orders).withColumn("context_id", F.col("ordinal")), "o_custkey")


@query("SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, ordinal) AS r FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'i' || p_size ELSE substr(p_name || p_brand, 1, 80) END AS id, p_name || p_brand AS title, p_partkey AS ordinal, CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS l FROM part)) WHERE r = 1")
def p05_collected_works(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_size", "CASE WHEN p_size % 2 = 0 THEN concat('i', p_size) ELSE '' END AS id", "concat(p_name, p_brand) AS title", "p_partkey AS ordinal")
    return S.collected_works([p.filter("p_size < 25"), p.filter("p_size >= 25")]).select("id", "title")


@query("SELECT model, query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, id) AS rank FROM (SELECT 'a' AS model, l_orderkey AS query_id, l_partkey AS id, l_discount AS score FROM lineitem UNION ALL SELECT 'b', l_orderkey, l_partkey, l_quantity FROM lineitem)) WHERE rank <= 3")
def r18_compared_models(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    named = {m: i.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col(c).cast("double").alias("score")) for m, c in (("a", "l_discount"), ("b", "l_quantity"))}
    return S.compared_models(named).select("model", "query_id", "id", "rank")


@query("SELECT c_name AS name, '' AS hometown, c_mktsegment AS education, 'u' || c_custkey AS unit_1, '' AS date_range_1, 'd' AS description_1, CASE WHEN c_custkey % 2 = 0 THEN 'v' ELSE '' END AS unit_2, CASE WHEN c_custkey % 2 = 0 THEN '1900-' ELSE '' END AS date_range_2, '' AS description_2, '' AS unit_3, '' AS date_range_3, '' AS description_3, c_custkey AS page, substr(repeat(c_name, 9), 1, 100) AS text FROM customer")
def k11_person_rows(spark, sf_dir):
    one = "struct(concat('u', c_custkey) AS unit, CAST(NULL AS STRING) AS date_range, 'd' AS description)"
    two = "struct('v' AS unit, '1900-' AS date_range, CAST(NULL AS STRING) AS description)"
    p = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "CAST(NULL AS STRING) AS hometown", "c_mktsegment AS education", f"filter(array({one}, IF(c_custkey % 2 = 0, {two}, NULL)), x -> x IS NOT NULL) AS experiences", "c_custkey AS page", "repeat(c_name, 9) AS text")
    return S.person_rows(p)


@query("SELECT '{\"page\":' || o_custkey || ',\"name\":\"n' || o_orderkey || '\",\"review\":' || (o_orderkey % 2 = 0) || '}' AS value FROM orders")
def z28_person_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 2 == 0).alias("review"))).alias("persons"))
    return S.person_lines(pages)


@query("SELECT conv_id, md5('## 第' || conv_id || '页' || chr(10) || chr(10) || '### 发言内容' || chr(10) || string_agg('**' || n || '. ' || role || '**' || chr(10) || CASE WHEN turn % 2 = 0 THEN '- 发言者: s' || turn || chr(10) ELSE '' END || '- 内容: ' || substr(text, 1, 200) || '...' || chr(10) || '- 置信度: ' || printf('%.2f', (turn % 4) / 4.0) || chr(10), chr(10) ORDER BY n)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) GROUP BY conv_id")
def k10_speech_notes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role IS NOT NULL").selectExpr("conv_id", "turn", "role AS kind", "CASE WHEN turn % 2 = 0 THEN concat('s', turn) ELSE '' END AS speaker", "text", "(turn % 4) / 4.0D AS confidence")
    return S.speech_notes(c, "conv_id", "turn").select("conv_id", F.md5("markdown").alias("digest"))
