"""Queries over texts built from the tables, for what the tables themselves do not hold: dates of eras, headings, citations, replies of models.

Their SQL says what was built in, not how it is found again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import citations as B
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import packages as K
from ..operators import records as R
from ..operators import retrieval as Q
from ..operators import runs as U
from ..operators import screening as C
from ..operators import summaries as S
from ..operators import workflow as W
from ..operators.spread import spread
from ..sources import readers
from .files import place
from .papers import _LINES, _lines
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _part(spark, sf_dir, text: str):
    """Parts with a column t, an expression of Spark SQL."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("t", F.expr(text))


@query("SELECT o_orderkey, printf('%04d-%02d-%02d', (CASE o_orderkey % 3 WHEN 0 THEN 1868 WHEN 1 THEN 1912 ELSE 1926 END) + o_orderkey % 14, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS date_key, (1 + o_orderkey % 14)::INT AS era_year FROM orders UNION ALL SELECT o_orderkey, '1926-12-25', 15 FROM orders WHERE o_orderkey % 2 = 0")
def d02_era_dates(spark, sf_dir):
    text = "concat(CASE o_orderkey % 3 WHEN 0 THEN '明治' WHEN 1 THEN '大正' ELSE '昭和' END, 1 + o_orderkey % 14, '年', 1 + o_orderkey % 12, '月', 1 + o_orderkey % 28, '日 晴。平成3年のみ。', CASE WHEN o_orderkey % 2 = 0 THEN '大正十五年十二月廿五日' ELSE '' END)"
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(D.era_dates(F.expr(text))).alias("d")).select("o_orderkey", "d.*")
    return d.select("o_orderkey", D.date_key(F.col("year"), F.col("month"), F.col("day")).alias("date_key"), "era_year")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_partkey WHEN 2 THEN 20 + p_size % 10 ELSE -1 END::INT AS value FROM part")
def d05_kanji_numbers(spark, sf_dir):
    ones, tens = "array('', '一', '二', '三', '四', '五', '六', '七', '八', '九')", "array('', '十', '二十', '三十', '四十', '五十')"
    text = f"CASE p_partkey % 4 WHEN 0 THEN concat({tens}[CAST(p_size div 10 AS INT)], {ones}[CAST(p_size % 10 AS INT)]) WHEN 1 THEN translate(CAST(p_partkey AS STRING), '0123456789', '〇一二三四五六七八九') WHEN 2 THEN concat('廿', {ones}[CAST(p_size % 10 AS INT)]) ELSE '第三' END"
    return _part(spark, sf_dir, text).select("p_partkey", F.coalesce(D.kanji_number(F.col("t")), F.lit(-1)).cast("int").alias("value"))


@query("SELECT p_partkey, ['single_page', 'distributed_pages', 'continuous_range', 'range_context', 'unmarked', 'unmarked', 'distributed_pages'][p_partkey % 7 + 1] AS mode, [1, 2, 2, 5, 0, 0, 3][p_partkey % 7 + 1] AS pages FROM part")
def e08_page_span(spark, sf_dir):
    p = "p_size"
    text = f"CASE p_partkey % 7 WHEN 0 THEN CAST({p} AS STRING) WHEN 1 THEN concat({p}, ', ', {p} + 4) WHEN 2 THEN concat({p}, '-', {p} + 1) WHEN 3 THEN concat({p}, ' - ', {p} + 4) WHEN 4 THEN '' WHEN 5 THEN concat({p} + 5, '-', {p}) ELSE concat({p}, '-', {p} + 2, ', ', {p} + 1) END"
    rows = _part(spark, sf_dir, text).withColumn("p", D.page_list(F.col("t")))
    mode = D.page_span(F.col("p"), F.col("t").rlike("[,，、;；]"), F.lit(0), F.lit(""), F.col("t").contains("-"))
    return rows.select("p_partkey", mode.alias("mode"), F.size("p").alias("pages"))


@query("SELECT p_partkey, 'The ' || p_name AS title, (1950 + p_size)::VARCHAR AS year, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '-' END AS volume, p_size || '-' || p_size + 9 AS pages, '10.1234/x' || p_partkey AS doi, CASE WHEN p_size % 2 = 0 THEN 0.94 ELSE 0.76 END::DOUBLE AS confidence, 'chicago' AS style FROM part")
def e01_citation_fields(spark, sf_dir):
    text = """concat('Smith, John. "The ', p_name, '." Journal of Trade, ', 1950 + p_size, CASE WHEN p_size % 2 = 0 THEN concat(', vol. ', p_size) ELSE '' END, ', pp. ', p_size, ' – ', p_size + 9, '. https://doi.org/10.1234/x', p_partkey)"""
    rows = _part(spark, sf_dir, text).withColumn("f", E.citation_fields(F.col("t")))
    return rows.select("p_partkey", "f.title", "f.year", F.coalesce("f.volume", F.lit("-")).alias("volume"), "f.pages", "f.doi", E.citation_confidence(F.col("f")).alias("confidence"), E.citation_style(F.col("t")).alias("style"))


@query("SELECT p_partkey, p_name || 'の手順' AS quote FROM part UNION ALL SELECT p_partkey, p_brand || ' quoted' FROM part UNION ALL SELECT p_partkey, 'twice said' FROM part WHERE p_size % 2 = 0")
def e07_quotes(spark, sf_dir):
    text = """concat('彼は「', p_name, 'の手順」と「短い」と述べ “', p_brand, ' quoted” とし', CASE WHEN p_size % 2 = 0 THEN '『twice said』 "twice said"' ELSE '' END)"""
    return _part(spark, sf_dir, text).select("p_partkey", F.explode(E.quotes(F.col("t"))).alias("quote"))


@query("SELECT p_partkey AS doc_id, s AS section, l AS level, replace(n, 'N', p_name) AS title, p AS parent FROM part, (VALUES (0, 0, 'Document Start', -1, 0), (1, 1, 'N', -1, 1), (2, 2, 'Part', 1, 1), (3, 3, 'Deep', 2, 1), (4, 2, 'Other', 1, 1), (5, 1, 'End', -1, 1)) v(s, l, n, p, k) WHERE k = 1 OR p_size % 2 = 0")
def s09_markdown_sections(spark, sf_dir):
    text = r"concat(CASE WHEN p_size % 2 = 0 THEN 'preface\n' ELSE '' END, '# ', p_name, ' #\nbody\n#no heading\n## Part\n### Deep\nx\n## Other\n\n# End')"
    docs = _part(spark, sf_dir, text).select(F.col("p_partkey").alias("doc_id"), F.col("t").alias("text"))
    return E.heading_parents(E.headings(docs)).select("doc_id", F.col("section").cast("int").alias("section"), "level", "title", F.coalesce(F.col("parent").cast("int"), F.lit(-1)).alias("parent"))


@query("SELECT p_partkey, p_name AS title, 'https://example.com/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, '', 'pic.png' FROM part WHERE p_size > 25")
def s10_markdown_links(spark, sf_dir):
    text = "concat('see [', p_name, '](https://example.com/', p_partkey, ') not [this] (one)', CASE WHEN p_size > 25 THEN ' ![](pic.png)' ELSE '' END)"
    return _part(spark, sf_dir, text).select("p_partkey", F.explode(X.links(F.col("t"))).alias("l")).select("p_partkey", "l.title", "l.url")


@query("SELECT p_partkey, 0 AS index, 'python' AS language, 2 AS line_count, 'a = ' || p_size || chr(10) || 'b = 2' || chr(10) || '```' AS preview FROM part UNION ALL SELECT p_partkey, 1, '', 1, p_name || chr(10) || '```' FROM part WHERE p_size % 2 = 0")
def s11_code_blocks(spark, sf_dir):
    text = r"concat('text\n```python\na = ', p_size, '\nb = 2\n```\nmid\n', CASE WHEN p_size % 2 = 0 THEN concat('```\n', p_name, '\n```') ELSE '``` open' END)"
    return _part(spark, sf_dir, text).select("p_partkey", F.explode(X.code_blocks(F.col("t"))).alias("b")).select("p_partkey", "b.*")


@query("SELECT p_partkey, ['pdf', 'markdown', 'text', 'html', 'docx', 'unknown', 'unknown'][p_partkey % 7 + 1] AS kind FROM part")
def s01_file_types(spark, sf_dir):
    text = "concat('a.txt/', p_name, '.', p_size, element_at(array('.PDF', '.markdown', '.txt', '.htm', '.docx', '.zip', '/none'), CAST(p_partkey % 7 + 1 AS INT)))"
    return _part(spark, sf_dir, text).select("p_partkey", X.file_type(F.col("t")).alias("kind"))


@query("SELECT p_partkey, ['japanese', 'chinese', 'general'][p_partkey % 3 + 1] AS language FROM part")
def c02_split_language(spark, sf_dir):
    text = "CASE p_partkey % 3 WHEN 0 THEN concat('日本の歴史です', p_brand) WHEN 1 THEN concat('江户幕府将军统治制度', p_size) ELSE concat(p_name, '史') END"
    return _part(spark, sf_dir, text).select("p_partkey", X.split_language(F.col("t")).alias("language"))


@query("SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN 'nobody' ELSE n_name END AS entity, ['gov law rule', 'the city', ''][c_custkey % 3 + 1] AS context, CASE WHEN c_custkey % 5 = 0 THEN 'nobody' WHEN c_custkey % 3 = 0 THEN n_name || ' state' ELSE n_name || ' city' END AS standard_name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE [0.8, 0.35, 0][c_custkey % 3 + 1] END::DOUBLE AS score, c_custkey % 5 <> 0 AS known FROM customer JOIN nation ON c_nationkey = n_nationkey")
def e13_disambiguation(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rule = lambda order, name, kind, patterns, keywords: n.select(F.col("n_name").alias("entity"), F.lit(order).alias("rule_order"), F.concat("n_name", F.lit(name)).alias("standard_name"), F.lit(kind).alias("category"), F.array(*map(F.lit, patterns)).alias("patterns"), F.array(*map(F.lit, keywords)).alias("keywords"))
    rules = rule(1, " city", "place", ["city"], ["town"]).unionByName(rule(2, " state", "organization", ["gov", "law"], ["rule", "none"]))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'nobody' ELSE n_name END").alias("entity"), F.expr("element_at(array('gov law rule', 'the city', ''), CAST(c_custkey % 3 + 1 AS INT))").alias("context"))
    return E.disambiguated(rows, rules).select("entity", "context", "standard_name", "score", "known")


@query("SELECT p_partkey, (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT AS missing, (2 - (p_partkey % 3 = 0)::INT - (p_partkey % 5 = 0)::INT) / 2 AS confidence FROM part")
def f14_required_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS name", "CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS category")
    missing, confidence = U.required_fields(["name", "category"])
    return rows.select("p_partkey", F.size(missing).alias("missing"), confidence.alias("confidence"))


def _works(spark, sf_dir):
    """Parts as works: two thirds name three or two words of the next one's title, the others one word of it."""
    word = lambda head, shift: f"concat('{head}', translate(CAST(p_partkey + {shift} AS STRING), '0123456789', 'abcdefghij'), 'z')"
    title = f"concat(initcap({word('topic', 0)}), ' of ', {word('study', 0)}, '; ', {word('notes', 0)})"
    text = f"concat('It builds on the pre', {word('topic', 1)}, 's', CASE WHEN p_partkey % 3 < 2 THEN concat(', and ', {word('study', 1)}) ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat(' or ', upper({word('notes', 1)})) ELSE '' END, '. notes, topic study')"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(title).alias("title"), F.expr(text).alias("text"), (F.lit(1950) + F.col("p_size")).cast("string").alias("year"))


@query("SELECT p_partkey AS source, p_partkey + 1 AS target, CASE WHEN p_partkey % 3 = 0 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM part WHERE p_partkey % 3 < 2 AND p_partkey + 1 IN (SELECT p_partkey FROM part)")
def j04_citation_edges(spark, sf_dir):
    return G.citation_edges(_works(spark, sf_dir)).select("source", "target", F.round("confidence", 4).alias("confidence"))


@query("SELECT p_partkey AS doc_id, 'missing_section' AS issue, 'analysis' AS section FROM part UNION ALL SELECT p_partkey, 'length_warning', NULL FROM part UNION ALL SELECT p_partkey, 'section_too_long', 'Introduction' FROM part UNION ALL SELECT p_partkey, 'section_too_short', 'Conclusion' FROM part WHERE p_size > 5")
def e20_outline_issues(spark, sf_dir):
    """Parts as papers with a long introduction and a conclusion of one word, or of a fifth of the whole."""
    p = table(spark, sf_dir, "part")
    intro = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("section"), F.lit("Introduction").alias("title"), F.expr("repeat('word ', 40)").alias("content"))
    end = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("section"), F.lit("Conclusion").alias("title"), F.expr("CASE WHEN p_size > 5 THEN 'x' ELSE repeat('x ', 10) END").alias("content"))
    notes = p.select(F.col("p_partkey").alias("doc_id"), F.lit(2).alias("section"), F.lit("References").alias("title"), F.lit("y").alias("content"))
    return S.outline_issues(S.outline_ratios(intro.unionByName(end).unionByName(notes)), ["introduction", "analysis", "conclusion"])


@query("SELECT p_partkey AS id, [1.0, 0.0, 0.9][p_partkey % 3 + 1]::DOUBLE AS score FROM part")
def r05_record_scores(spark, sf_dir):
    other = "CASE WHEN p_partkey % 3 = 2 THEN 'someone' ELSE p_brand END"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 1 THEN '' ELSE concat('満洲 ', p_name) END AS title", "p_brand AS author", "'1970' AS year", "CAST(NULL AS STRING) AS publisher", "concat('満洲・', p_name) AS r_title", f"{other} AS r_author", "'c1970' AS r_year", "'x' AS r_publisher")
    return R.record_scores(rows).select("id", F.round("score", 4).alias("score"))


@query(f"SELECT book, (2 + book % 3)::INT AS per_scan FROM {_LINES} GROUP BY book HAVING count(*) >= 3")
def w07_pages_per_scan(spark, sf_dir):
    """Orders as books of 2 to 4 pages a scan; the second of two scans of the longest orders shows a number from elsewhere."""
    line = _lines(spark, sf_dir).select("book", F.col("n").alias("scan"))
    per = 2 + F.col("book") % 3
    number = F.explode(F.sequence(F.lit(10) + (F.col("scan") - 1) * per, F.lit(9) + F.col("scan") * per))
    seen = line.select("book", "scan", number.alias("number")).unionByName(line.filter("scan = 6").select("book", "scan", F.lit(900).cast("long").alias("number")))
    return R.pages_per_scan(seen, "book").select("book", F.col("per_scan").cast("int").alias("per_scan"))


@query("SELECT p_partkey AS id, k::INT AS ordinal, p_brand || CASE WHEN k > 2 THEN ' v' || p_size ELSE '' END || CASE WHEN k % 2 = 0 THEN ' 1904' ELSE '' END AS query FROM part, range(1, 5) t(k)")
def m12_query_terms(spark, sf_dir):
    plans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.concat(F.lit(" "), "p_brand")).alias("anchors"), F.array(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("volumes"), F.array(F.lit("1904")).alias("specifics"))
    return R.query_terms(plans)


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS complete, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS covered, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS hits FROM part")
def z21_facet_packets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    facets = p.select(F.col("p_partkey").alias("id"), F.lit("who").alias("facet"), F.array("p_name").alias("terms"), F.lit(True).alias("required")).unionByName(p.select(F.col("p_partkey").alias("id"), F.lit("when"), F.array(F.lit("昭和")), F.lit(True)).toDF("id", "facet", "terms", "required"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("の昭和史"))).otherwise(F.col("p_name"))
    contexts = p.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ordinal"), text.alias("text")).unionByName(p.select(F.col("p_partkey").alias("id"), F.lit(1), F.concat("p_name", F.lit("調査部"))).toDF("id", "ordinal", "text"))
    return R.facet_packets(facets, contexts)


@query(f"SELECT book AS doc_id, n AS ordinal, CASE WHEN n % 2 = 0 THEN 'T' || n - 1 ELSE 'T' || n END AS resolved_title FROM {_LINES}")
def j12_aliased_titles(spark, sf_dir):
    """Orders as documents: every other footnote uses the short title that the one before it defines; the last defines one that is not used yet."""
    line = _lines(spark, sf_dir).select(F.col("book").alias("doc_id"), F.col("n").cast("long").alias("ordinal"))
    title = F.expr("CASE WHEN ordinal % 2 = 0 THEN concat('alias', ordinal - 1) ELSE concat('T', ordinal) END")
    defines = F.expr("CASE WHEN ordinal % 2 = 1 THEN array(concat('alias', ordinal), concat('T', ordinal)) ELSE array(concat('alias', ordinal)) END")
    return R.aliased_titles(line.withColumns({"title": title, "defines": defines})).select("doc_id", "ordinal", "resolved_title")


@query("SELECT p_partkey, p_size AS best_index, 0.88::DOUBLE AS confidence FROM part")
def m05_first_json(spark, sf_dir):
    text = r"""concat('Reply: ```json\n{"best_index": ', p_size, ', "confidence": 0.88, "other": {"a": 1}}\n``` done')"""
    return _part(spark, sf_dir, text).select("p_partkey", R.first_json(F.col("t"), "best_index int, confidence double").alias("j")).select("p_partkey", "j.*")


@query("SELECT p_partkey, p_size AS a, p_brand AS b FROM part")
def m05_first_valid_json(spark, sf_dir):
    text = """concat('note {x} and {"a": ', p_size, ', "b": "', p_brand, '"} {"a": 2}')"""
    return _part(spark, sf_dir, text).select("p_partkey", R.first_json(F.col("t"), "a int, b string").alias("j")).select("p_partkey", "j.*")


@query(f"WITH e AS (SELECT mode AS text, l_returnflag AS category, l_suppkey AS start, l_suppkey + 2 AS stop, l_discount AS confidence, l_tax > 0.04 AS r, book * 100 + n AS ord FROM {_LINES}), b AS (SELECT text, category, start, max(confidence) AS confidence, arg_min(ord, ord) FILTER (WHERE confidence = m) AS best FROM (SELECT *, max(confidence) OVER (PARTITION BY text, category, start) AS m FROM e) GROUP BY text, category, start) SELECT b.text, b.category, b.start, b.start + 2 AS stop, b.confidence, bool_or(e.r) AS needs_review FROM b JOIN e ON b.text = e.text AND b.category = e.category AND b.start = e.start AND e.ord >= b.best GROUP BY ALL")
def z02_merged_entities(spark, sf_dir):
    """Lines as finds of an entity, its mode, at a place, its supplier."""
    rows = _lines(spark, sf_dir).select((F.col("book") * 100 + F.col("n")).alias("ord"), F.col("mode").alias("text"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + 2).alias("stop"), F.col("l_discount").alias("confidence"), (F.col("l_tax") > 0.04).alias("needs_review"))
    return W.merged_entities(rows)


@query("SELECT p_partkey, '本文 ' || p_name || chr(10) || '次の行' || p_size AS text FROM part")
def x03_cleaned_ocr(spark, sf_dir):
    text = r"concat('本文　　', p_name, ' \n - ', p_size, ' - \n 次の行', char(7), p_size)"
    return _part(spark, sf_dir, text).select("p_partkey", W.cleaned_ocr(F.col("t")).alias("text"))


@query("SELECT p_partkey AS scan, (p_size + k)::INT AS number FROM part, range(2) t(k)")
def e24_visible_page_numbers(spark, sf_dir):
    text = r"concat(p_size, '\ntext 99 here\n - ', p_size + 1, ' -\n12345\n')"
    return _part(spark, sf_dir, text).select(F.col("p_partkey").alias("scan"), F.explode(W.visible_page_numbers(F.col("t"))).alias("number"))


@query("SELECT lang, source, 'text' AS kind, sum(length(text) + 1)::BIGINT AS characters FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def s04_directory_scan(spark, sf_dir):
    """Documents written by Spark as text files in a folder for each language and source, and scanned again."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").select("lang", "source", "text")
    d.repartition("lang", "source").write.partitionBy("lang", "source").text(path := place(spark, "files"))
    found = readers.documents(spark, path)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    return found.groupBy(part("lang"), part("source"), "kind").agg(F.sum(F.length("text")).cast("long").alias("characters"))


_SOURCES = "SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"


@query(f"SELECT query_id, string_agg('[doc' || vec_id % 7 || '] ' || substr('text of chunk ' || vec_id || ': ' || repeat('word ', (vec_id % 90)::INT), 1, 300), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS answer, round(avg(score), 6) AS confidence, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS sources FROM ({_SOURCES}) WHERE rank <= 4 GROUP BY query_id")
def r15_answers(spark, sf_dir):
    """Vectors whose id is divisible by 20 as questions; chunks have texts of their ids."""
    text = "concat('text of chunk ', vec_id, ': ', repeat('word ', CAST(vec_id % 90 AS INT)))"
    e = table(spark, sf_dir, "embeddings").withColumns({"text": F.expr(text), "source": F.expr("concat('doc', vec_id % 7)")})
    found = Q.answered(e.filter("vec_id % 20 = 0"), e, 4)
    return found.select("query_id", "answer", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT p_partkey AS source, p_partkey + 1 AS target FROM part WHERE p_partkey % 3 < 2 AND p_partkey + 1 IN (SELECT p_partkey FROM part) ORDER BY p_partkey LIMIT 500")
def p07_citation_network(spark, sf_dir):
    """The report's edges; it keeps the first 500."""
    return G.citation_network(_works(spark, sf_dir))[1].select("source", "target")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 23 WHEN 2 THEN 7 ELSE -1 END::INT AS page_number, CASE WHEN p_partkey % 2 = 0 THEN '第三章 ' || p_name ELSE '' END AS header, CASE WHEN p_size % 2 = 0 THEN '二、' || p_name ELSE '' END AS footer, CASE WHEN p_partkey % 2 = 1 THEN 'opening' || chr(10) ELSE '' END || 'body of ' || p_brand || '.' || chr(10) || 'more.' || chr(10) || 'end.' AS body FROM part")
def e18_page_furniture(spark, sf_dir):
    """Parts as pages: a chapter's heading or not, a section's heading at the foot or not, and a number in some form."""
    text = r"concat(CASE WHEN p_partkey % 2 = 0 THEN concat('第三章 ', p_name) ELSE 'opening' END, '\nbody of ', p_brand, '.\nmore.\nend.\n', CASE WHEN p_size % 2 = 0 THEN concat('二、', p_name, '\n') ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN concat('- ', p_size, ' -') WHEN 1 THEN '— 二十三 —' WHEN 2 THEN '七' ELSE '' END)"
    p = _part(spark, sf_dir, text).withColumn("t", F.when((F.col("p_partkey") % 4 == 3) & (F.col("p_size") % 2 == 0), F.concat("t", F.lit("."))).otherwise(F.col("t")))
    found = C.page_furniture(p.select("p_partkey", "p_brand", F.col("t").alias("text")))
    return found.select("p_partkey", F.coalesce("page_number", F.lit(-1)).alias("page_number"), "header", "footer", "body")


@query("SELECT p_partkey, ['unknown', 'header', 'footer', 'date', 'title', 'body_text', 'date'][p_partkey % 7 + 1] AS region, ['unknown', 'handwritten', 'quote', 'date', 'weather', 'handwritten', 'handwritten'][p_partkey % 7 + 1] AS content FROM part")
def e19_region_classes(spark, sf_dir):
    text = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat(p_brand, ' 序') WHEN 2 THEN concat('「', p_name, '」') WHEN 3 THEN concat('昭和五年三月一日 ', p_brand) WHEN 4 THEN '序 晴' WHEN 5 THEN concat(repeat('長い本文', 12), p_brand) ELSE concat('1904年3月5日 ', p_brand) END"
    top, bottom = F.when(F.col("p_partkey") % 7 == 1, 10).otherwise(400), F.when(F.col("p_partkey") % 7 == 2, 990).otherwise(600)
    return _part(spark, sf_dir, text).select("p_partkey", C.region_class(F.col("t"), top, bottom, F.lit(1000)).alias("region"), C.content_class(F.col("t")).alias("content"))


@query(f"WITH l AS (SELECT book, n, ['National ARCHIVES, and laws', 'letters', 'census', 'none', 'Annals', 'a law', 'Journals'][l_partkey % 7 + 1] AS t FROM {_LINES}), k AS (SELECT book, n * 10 + o AS pos, h FROM l JOIN (VALUES ('National ARCHIVES, and laws', 0, 'archive'), ('National ARCHIVES, and laws', 6, 'legal'), ('letters', 5, 'correspondence'), ('census', 7, 'statistical'), ('Annals', 2, 'chronicle'), ('a law', 6, 'legal'), ('Journals', 3, 'parliament')) v(t, o, h) USING (t) WHERE n <= 15), f AS (SELECT book, h, min(pos) AS pos FROM k GROUP BY book, h) SELECT b.book, COALESCE(string_agg(h, ',' ORDER BY pos), '') AS hints FROM (SELECT DISTINCT book FROM l) b LEFT JOIN f ON f.book = b.book GROUP BY b.book")
def e22_source_hints(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, ("National ARCHIVES, and laws", "letters", "census", "none", "Annals", "a law", "Journals"))), (F.col("l_partkey") % 7).cast("int"))
    works = _lines(spark, sf_dir).select("book", "n", F.when(F.col("n") % 2 == 0, said).alias("title"), F.when(F.col("n") % 2 == 1, said).alias("abstract"))
    return C.source_hints(works, "book", "n").select("book", F.array_join("hints", ",").alias("hints"))


@query(f"SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY [0, 1, 2, 3, 4, 5, 0][l_partkey % 7 + 1], l_returnflag <> 'R', l_linestatus <> 'O', l_discount DESC, l_tax <= 0.04, l_quantity <= 25, n) AS rank FROM {_LINES} WHERE l_suppkey % 3 < 2")
def t_k11_ordered_leads(spark, sf_dir):
    """Lines of orders as hints; a third belongs to another source than the preferred one."""
    category = F.get(F.array(*map(F.lit, (*C.LEADS, "other", "body_candidate"))), (F.col("l_partkey") % 7).cast("int"))
    source = F.when(F.col("l_suppkey") % 3 == 0, "s").when(F.col("l_suppkey") % 3 == 2, "other")
    hints = _lines(spark, sf_dir).select("book", "n", category.alias("category"), (F.col("l_returnflag") == "R").alias("has_claim"), (F.col("l_linestatus") == "O").alias("is_specific"), F.col("l_discount").alias("specificity"), (F.col("l_tax") > 0.04).alias("has_context"), (F.col("l_quantity") > 25).alias("has_page"), source.alias("source_id"), F.lit("s").alias("wanted"), F.col("n").alias("ordinal"))
    return C.ordered_leads(hints, "book", "wanted").select("book", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey AS id, f AS facet_id, r AS required, CASE WHEN f = 'bucket_theme' THEN 2 ELSE 1 END AS terms FROM part, (VALUES (0, 'bucket_theme', true), (0, 'bucket_policy', true), (0, 'bucket_person', false), (1, 'bucket_theme', true), (1, 'bucket_person', true), (1, 'bucket_date', false), (3, 'bucket_theme', true), (3, 'bucket_date', true)) v(k, f, r) WHERE p_partkey % 4 = k")
def z22_generic_facets(spark, sf_dir):
    """Parts as plans of four kinds: enough of themselves, with a person, too few, with an event's date."""
    kind = F.col("p_partkey") % 4
    entry = lambda when, bucket, ordinal, term: F.when(when, F.struct(F.lit(bucket).alias("bucket"), F.lit(ordinal).alias("ordinal"), term.alias("term")))
    entries = F.array_compact(F.array(entry(kind.isin(0, 1, 3), "theme", 0, F.lit(" 満鉄調査 ")), entry(kind.isin(0, 1, 3), "theme", 1, F.col("p_name")), entry(kind.isin(0, 1, 3), "theme", 2, F.col("p_name")), entry(kind == 0, "policy", 0, F.lit("委任統治")), entry(kind.isin(0, 1), "person", 0, F.lit("後藤新平")), entry(kind == 1, "date", 0, F.lit("一九三一年")), entry(kind == 2, "document_title", 0, F.lit("満洲国史")), entry(kind == 2, "policy", 0, F.lit("・・短")), entry(kind == 3, "date", 0, F.lit("三月五日")), entry(kind == 3, "unknown", 0, F.lit("無視する"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(entries).alias("e")).select("id", "e.*")
    return C.generic_facets(rows).select("id", "facet_id", "required", F.size("terms").alias("terms"))


@query(f"WITH m AS (SELECT book AS pid, n, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'see ' || mode || ' there' END AS snippet, CASE WHEN l_suppkey % 4 = 0 THEN 500 + l_suppkey ELSE n + 1 END AS pdf_page FROM {_LINES} WHERE book % 3 < 2), f AS (SELECT pid, snippet, pdf_page, min(n) AS n FROM m WHERE snippet <> '' AND NOT (snippet = 'see AIR there' AND pdf_page = 2) GROUP BY pid, snippet, pdf_page) SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY n) - 1 AS ordinal, snippet, pdf_page FROM f")
def z14_merged_snippets(spark, sf_dir):
    """Lines of orders as contents of a reply; a third of the orders is unknown, some contents have a mapped page, one hint is known."""
    line = _lines(spark, sf_dir)
    match = F.struct(F.lit("see  ").alias("head"), F.col("mode").alias("word"), F.lit("\nthere ").alias("tail"))
    none = F.struct(F.lit(" ").alias("head"), F.lit(None).cast("string").alias("word"), F.lit("").alias("tail"))
    contents = line.select(F.col("book").alias("pid"), F.col("n").alias("ordinal"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("cid"), F.col("n").alias("index"), F.when(F.col("l_returnflag") == "R", F.array(none)).otherwise(F.array(match, match)).alias("matches"))
    maps = line.filter("l_suppkey % 4 = 0").select(F.col("book").alias("pid"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("cid"), (F.lit(500) + F.col("l_suppkey")).alias("page")).distinct()
    records = line.filter("book % 3 < 2").select(F.col("book").alias("pid")).distinct()
    known = records.select("pid", F.lit("see AIR there").alias("snippet"), F.lit(2).cast("long").alias("pdf_page"))
    found = C.merged_snippets(records, known, contents, maps)
    return found.select("pid", F.col("ordinal").cast("long").alias("ordinal"), "snippet", F.col("pdf_page").cast("long").alias("pdf_page"))


@query("SELECT event_id, ['direct_support', 'page_mismatch_but_support', 'partial_support', 'needs_manual_review', 'not_supported', 'needs_manual_review', 'page_mismatch_but_support', 'partial_support', 'partial_support', 'direct_support', 'partial_support'][event_id % 11 + 1] AS support, ['matched', 'matched', 'needs_manual_review', 'needs_manual_review', 'needs_manual_review', 'needs_manual_review', 'matched', 'needs_manual_review', 'needs_manual_review', 'matched', 'needs_manual_review'][event_id % 11 + 1] AS verification FROM events")
def m11_support_assessment(spark, sf_dir):
    """Events as candidates of eleven kinds, five of them reviewed."""
    i = F.col("event_id") % 11
    decision = F.when(i.isin(0, 1), "direct_support").when(i == 2, "partial_support").when(i == 3, "uncertain").when(i == 10, "uncertain")
    exact, reason = F.when(i.isin(0, 1), "a sentence"), F.when(i == 3, "why")
    matched = F.when(i == 4, "").otherwise("text")
    confidence = F.when(i == 5, 0.1).when(i.isin(7, 10), 0.3).otherwise(0.7)
    distance = F.when(i.isin(1, 6, 7), 3).otherwise(0)
    scope = F.when(i == 8, "context_fallback").otherwise("cited_pages")
    notes = F.when(i == 4, "LLM_rejected_candidates: no").otherwise("fine")
    return table(spark, sf_dir, "events").select("event_id", C.support_assessment(decision, exact, reason, matched, confidence, distance, scope, notes).alias("s")).select("event_id", "s.*")


@query("SELECT p_partkey, ['chicago', 'apa', 'mla', 'gb7714', 'ieee', 'apa', 'unknown', 'chicago'][p_partkey % 8 + 1] AS style FROM part")
def e02_detected_style(spark, sf_dir):
    """Eight kinds of citations; in the sixth two styles have a mark each, in the last one the first style of three."""
    text = """CASE p_partkey % 8 WHEN 0 THEN concat('A. "', p_name, '." J. 1999, 3') WHEN 1 THEN concat('A. (1999b). The ', p_name, '. 12(3)') WHEN 2 THEN concat('A, ', p_name, ', VOL. 3, PP. 4') WHEN 3 THEN concat('[1] A ', p_name, '[J]') WHEN 4 THEN concat('[2] A, ', p_name, ', vol. 3, no. 2') WHEN 5 THEN concat('A (1999) "', p_name) WHEN 6 THEN p_name ELSE concat('A. ', p_name, '. 1999, vol. 3') END"""
    return _part(spark, sf_dir, text).select("p_partkey", K.detected_style(F.col("t")).alias("style"))


@query("SELECT p_partkey, [0.0, 0.6, 0.5, 0.75][p_partkey % 4 + 1]::DOUBLE AS disambiguation, [0.45, 0.8, 0.66, 0.45][p_partkey % 4 + 1]::DOUBLE AS biography, [0.2, 0.9, 0.64, 0.84][p_partkey % 4 + 1]::DOUBLE AS recognition, [0.0, 0.9, 0.6, 0.35][p_partkey % 4 + 1]::DOUBLE AS embedding FROM part")
def m02_confidences(spark, sf_dir):
    """Four kinds of packages: failed, whole, flagged, empty."""
    k, none = F.col("p_partkey") % 4, F.array().cast("array<string>")
    flags = F.when(k == 2, F.array(F.lit("unknown_entity_rules"), F.lit("mock_embedding_used"), F.lit("no_results"), F.lit("no_results"))).otherwise(none)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        K.disambiguation_confidence(F.when(k == 0, 0).otherwise(3), F.when(k == 3, 0.75).otherwise(0.6), flags).alias("disambiguation"),
        K.biography_confidence(F.when(k.isin(1, 2), 2).otherwise(0), F.when(k == 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(none)).alias("biography"),
        K.recognition_confidence(k != 0, F.lit(1), F.when(k == 3, 0).otherwise(9), F.when(k == 2, F.array(F.lit("x"))).otherwise(none)).alias("recognition"),
        K.embedding_confidence(k != 0, k.isin(1, 2), F.when(k == 3, 0).otherwise(5), F.when(k == 3, F.array(F.lit("no_results"), F.lit("empty_query"))).otherwise(flags)).alias("embedding"),
    )


@query("SELECT p_partkey, ['objective', 'subjective', 'mixed'][p_partkey % 3 + 1] AS perspective, CASE WHEN p_size % 2 = 0 THEN 'critical' ELSE 'measured' END AS stance, ['comparison-heavy', 'enumerative', 'logical-argumentation', 'comparison-heavy'][p_partkey % 4 + 1] AS preference, ['comparative', 'deductive', 'deductive', 'deductive'][p_partkey % 4 + 1] AS mode FROM part")
def e21_tone_and_rhetoric(spark, sf_dir):
    text = "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' research shows; 资料显示; I argue' WHEN 1 THEN ' I suggest, 笔者认为; research shows' ELSE ' In My View' END, CASE WHEN p_size % 2 = 0 THEN ' however insufficient' ELSE ' however' END, CASE p_partkey % 4 WHEN 0 THEN ' IN CONTRAST' WHEN 1 THEN ' First, 因此' WHEN 2 THEN ' thus' ELSE ' whereas, second, hence 因为' END)"
    rows = _part(spark, sf_dir, text).select("p_partkey", K.tone(F.col("t")).alias("t"), K.rhetoric(F.col("t")).alias("r"))
    return rows.select("p_partkey", "t.perspective", "t.stance", "r.preference", "r.mode")


@query("SELECT p_partkey, ['direct_support', 'uncertain', 'partial_support', 'direct_support', 'uncertain'][p_partkey % 5 + 1] AS decision, [2, 0, 1, 1, 0][p_partkey % 5 + 1] AS best_index, CASE p_partkey % 5 WHEN 0 THEN 'second ' || p_name WHEN 3 THEN p_brand ELSE '' END AS exact_sentence, [1.0, 0.0, 0.25, 0.5, 0.0][p_partkey % 5 + 1]::DOUBLE AS confidence FROM part")
def m05_review_payload(spark, sf_dir):
    """Replies of five kinds: an invented sentence, none at all, partial support, a part of the named sentence, strange values."""
    kinds = [("direct_support", "2", "1.7", F.lit("invented")), (" direct_support ", "9", "-2", F.lit(" ")), ("partial_support", "1", "0.25", F.col("p_name")), ("direct_support", " 1 ", "5e-1", F.col("p_brand")), ("yes", "x", "high", F.col("p_name"))]
    replies = F.array(*[F.struct(F.lit(d).alias("decision"), F.lit(i).alias("best_index"), F.lit(c).alias("confidence"), e.alias("exact_sentence"), F.lit("why").alias("reason")) for d, i, c, e in kinds])
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(replies, (F.col("p_partkey") % 5).cast("int")).alias("reply"), F.array(F.concat(F.lit("first "), "p_brand", F.lit(" here")), F.concat(F.lit("second "), "p_name")).alias("sentences"))
    return p.select("p_partkey", K.review_payload(F.col("reply"), F.col("sentences")).alias("r")).select("p_partkey", "r.decision", "r.best_index", "r.exact_sentence", "r.confidence")


@query("SELECT p_partkey AS doc_id, t AS \"table\", r AS row, replace(c, 'N', p_name) AS cells FROM part, (VALUES (0, 0, 'N|a'), (0, 1, 'b|c|d'), (1, 0, 'x|y')) v(t, r, c) WHERE t = 0 OR p_size % 2 = 0")
def e09_text_tables(spark, sf_dir):
    text = r"concat('title\n', p_name, '\t\ta\n b ,, c，，d \n\n', CASE WHEN p_size % 2 = 0 THEN 'x\ty' ELSE 'x, y' END)"
    docs = _part(spark, sf_dir, text).select(F.col("p_partkey").alias("doc_id"), F.col("t").alias("text"))
    return K.text_tables(docs).select("doc_id", F.col("table").cast("int").alias("table"), "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT p_partkey AS doc_id, l AS list, r AS row, replace(i, 'N', p_name) AS item, k AS kind FROM part, (VALUES (0, 0, 'N', 'ordered'), (0, 1, 'two', 'ordered'), (1, 0, 'x', 'bullet'), (1, 1, 'third', 'bullet')) v(l, r, i, k)")
def e09_text_lists(spark, sf_dir):
    text = r"concat('intro\n 1. ', p_name, '\n② two\n\n- x\n3、third\n4 no')"
    docs = _part(spark, sf_dir, text).select(F.col("p_partkey").alias("doc_id"), F.col("t").alias("text"))
    return K.text_lists(docs).select("doc_id", F.col("list").cast("int").alias("list"), "row", "item", "kind")


@query(f"WITH r AS (SELECT book AS query, n, CASE WHEN n % 3 = 0 THEN '' ELSE 'id' || l_partkey % 5 END AS source_id, mode AS url, l_returnflag AS route, CASE WHEN n % 2 = 0 THEN l_linestatus ELSE '' END AS author FROM {_LINES}), k AS (SELECT *, CASE WHEN source_id <> '' THEN source_id ELSE url END AS k FROM r), g AS (SELECT query, k, min(n) AS first, arg_min(author, n) FILTER (WHERE author <> '') AS author, list(route ORDER BY n) AS routes, count(DISTINCT route) AS n_hints FROM k GROUP BY query, k) SELECT query, row_number() OVER (PARTITION BY query ORDER BY first) AS rank, COALESCE(author, '') AS author, array_to_string(list_filter(routes, lambda x, i: list_position(routes, x) = i), ',') AS routes, n_hints FROM g")
def z12_merged_records(spark, sf_dir):
    line = _lines(spark, sf_dir)
    records = line.select(F.col("book").alias("query"), F.lit(0).alias("list"), F.col("n").alias("ordinal"), F.col("mode").alias("title"), F.expr("CASE WHEN n % 3 = 0 THEN '' ELSE concat('id', l_partkey % 5) END").alias("source_id"), F.col("mode").alias("url"), F.expr("CASE WHEN n % 2 = 0 THEN l_linestatus END").alias("author"), *(F.lit("").alias(c) for c in ("date", "publisher", "pdf_url")), F.col("l_returnflag").alias("route"), F.array(F.struct(F.col("l_returnflag").alias("snippet"), F.lit(1).alias("pdf_page"))).alias("hints"))
    found = K.merged_records(records)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "author", F.array_join("routes", ",").alias("routes"), F.size("hints").cast("long").alias("n_hints"))


@query(f"SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY l_returnflag = 'R', l_suppkey % 5, l_discount DESC, n) AS rank FROM {_LINES}")
def z11_source_order(spark, sf_dir):
    matches = _lines(spark, sf_dir).select("book", "n", (F.col("l_returnflag") == "R").alias("mismatch"), (F.col("l_suppkey") % 5).alias("priority"), F.col("l_discount").alias("effective_score"), F.col("n").alias("source_rank"))
    return K.ordered_sources(matches, "book").select("book", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS speaker FROM events), c AS (SELECT speaker, count(*) AS n FROM s WHERE speaker <> '' GROUP BY speaker) SELECT 'speeches' AS measure, '' AS name, count(*) AS n FROM s UNION ALL SELECT 'dates', '', count(*) FROM orders UNION ALL SELECT 'entities', '', count(*) FROM part UNION ALL SELECT 'speakers', '', count(*) FROM c UNION ALL (SELECT 'speaker', speaker, n FROM c ORDER BY n DESC, speaker LIMIT 10) UNION ALL SELECT 'kind', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'year', 'min', min(year(o_orderdate)) FROM orders UNION ALL SELECT 'year', 'max', max(year(o_orderdate)) FROM orders")
def g12_record_statistics(spark, sf_dir):
    speeches = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 3 <> 0 THEN concat('u', user_id) ELSE '' END AS speaker")
    return K.record_statistics(speeches, table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) AS year"), table(spark, sf_dir, "part").selectExpr("p_type AS category"))


_BOOK = "SELECT p_partkey, style, CASE style {} END AS text FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '未知作者' ELSE p_brand END AS a, p_name AS t, CASE WHEN p_partkey % 7 = 0 THEN '未知出版社' ELSE p_type END AS p, CASE WHEN p_partkey % 3 = 0 THEN 'n.d.' ELSE (1950 + p_size)::VARCHAR END AS y, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS n, CASE WHEN p_partkey % 4 < 2 THEN '2nd ed' ELSE '' END AS e FROM part), (VALUES ('chicago'), ('apa'), ('gb7714'), ('mla'), ('ieee'), ('harvard')) s(style)"
_BOOKS = {
    "chicago": "a || '. ' || t || ' [M]. ' || p || ', ' || y || '.' || CASE WHEN e <> '' THEN ' ' || e || '.' ELSE '' END || CASE WHEN n <> '' THEN ' pp. ' || n || '.' ELSE '' END",
    "apa": "a || ' (' || y || '). ' || t || CASE WHEN e <> '' THEN ' (' || e || ')' ELSE '' END || '. ' || p || '.' || CASE WHEN n <> '' THEN ' ' || n || 'p.' ELSE '' END",
    "gb7714": "'[' || p_partkey + 1 || '] ' || a || '. ' || t || ' [M]. ' || p || ', ' || y || CASE WHEN n <> '' THEN ': ' || n ELSE '' END || '.'",
    "mla": "a || '. ' || t || ' [M]. ' || p || ', ' || y || '.' || CASE WHEN n <> '' THEN ' Print.' ELSE '' END",
    "ieee": "a || ', ' || t || '. ' || p || ', ' || y || CASE WHEN n <> '' THEN ', pp. ' || n ELSE '' END || '.'",
    "harvard": "a || ' (' || y || ') ' || t || '. ' || p || CASE WHEN n <> '' THEN ', pp. ' || n ELSE '' END || '.'",
}


@query(_BOOK.format(" ".join(f"WHEN '{name}' THEN {form}" for name, form in _BOOKS.items())))
def e04_rendered_books(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    author, publisher = F.when(k % 5 == 0, F.lit("未知")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit("  "))), F.when(k % 7 != 0, F.col("p_type"))
    year, pages, edition = F.when(k % 3 != 0, (F.lit(1950) + F.col("p_size")).cast("string")), F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("未知"), F.when(k % 4 < 2, "2nd ed").otherwise("")
    rows = F.array(*[F.struct(F.lit(style).alias("style"), B.rendered_book(style, F.col("p_name"), author, publisher, year, pages, edition, k + 1).alias("text")) for style in B.BOOKS])
    return p.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.style", "r.text")


@query("SELECT p_partkey, '昭和' || 5 + p_size || '年3月5日' AS first, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE 2 END AS variants, CASE WHEN p_partkey % 2 = 0 THEN '1912年' ELSE '昭和五年三' END AS last_date FROM part")
def d07_era_variants(spark, sf_dir):
    """A date in one era, and for every other part a year that two eras share; and the dates of the same text as they stand."""
    text = "concat('At ', 1930 + p_size, '年 3月05日, ', CASE WHEN p_partkey % 2 = 0 THEN '1912年' ELSE '' END, ' 昭和五年三月')"
    rows = _part(spark, sf_dir, text).select("p_partkey", D.era_variants(F.col("t")).alias("v"), D.source_dates(F.col("t")).alias("d"))
    last = F.when(F.col("p_partkey") % 2 == 0, F.try_element_at("d", F.lit(-1))).otherwise(F.concat(F.rtrim(F.get("d", F.lit(1))), F.lit("三")))
    return rows.select("p_partkey", F.get("v", F.lit(0)).alias("first"), F.size("v").alias("variants"), last.alias("last_date"))
