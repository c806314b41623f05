"""Queries for retrieval, ranking and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from .tables import table

QUERIES, SQL = {}, {}
WORDS = "the thing that ended with the end"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_FROM0 = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank {_FROM0} ORDER BY {_COS} DESC, vec_id LIMIT 10")
def r01_cosine_topk(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)
    return best.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def r09_batch_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    best = R.batch_top_k(e.filter("vec_id % 20 = 0"), e, 5)
    return best.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT e.vec_id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2), 6) AS score " + _FROM0)
def r03_l2_similarity(spark, sf_dir):
    held = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.l2_similarity(F.col("embedding"), held), 6).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score {_FROM0} WHERE e.label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def f01_prefilter_topk(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, where=F.col("label") == 3)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM (SELECT e.vec_id, e.label, round({_COS}, 6) AS score {_FROM0} ORDER BY {_COS} DESC, vec_id LIMIT 40) WHERE label = 3")
def f01_postfilter_topk(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 40, where=F.col("label") == 3, post_filter=True)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM (SELECT e.vec_id, round({_COS}, 6) AS score {_FROM0} ORDER BY {_COS} DESC, vec_id LIMIT 25) WHERE score >= 0.1")
def f04_threshold(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 25, threshold=0.1)
    return best.select("vec_id", F.round("score", 6).alias("score"))


_TERMS = WORDS.split()
_TF = "len(list_filter(t, lambda x: x = '{0}'))"
_BM25 = " + ".join(f"(CASE WHEN {_TF.format(w)} > 0 THEN {_TF.format(w)} * 2.5 / ({_TF.format(w)} + 1.5 * (0.25 + 0.75 * len(t) / 100.0)) ELSE 0 END)" for w in _TERMS)
_SCORED = f"SELECT doc_id, {_BM25} AS score FROM (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[a-z]+|[0-9]+') AS t FROM documents)"


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_SCORED}) ORDER BY score DESC, doc_id LIMIT 10")
def r06_keyword_topk(spark, sf_dir):
    scores = R.keyword_scores(table(spark, sf_dir, "documents"), WORDS)
    return scores.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT e.vec_id AS doc_id, {_COS} AS score {_FROM0} ORDER BY score DESC, doc_id LIMIT 20),
w AS (SELECT * FROM ({_SCORED}) ORDER BY score DESC, doc_id LIMIT 20),
m AS (SELECT COALESCE(v.doc_id, w.doc_id) AS doc_id, COALESCE(v.score / (SELECT max(score) FROM v), 0) * 0.7 + COALESCE(w.score / (SELECT max(score) FROM w), 0) * 0.3 AS score FROM v FULL JOIN w ON v.doc_id = w.doc_id)
SELECT doc_id, round(score, 6) AS score FROM m ORDER BY m.score DESC, doc_id LIMIT 10""")
def r07_hybrid_topk(spark, sf_dir):
    """Embeddings stand in for the documents with their id."""
    v = R.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).select(F.col("vec_id").alias("doc_id"), "score")
    w = R.keyword_scores(table(spark, sf_dir, "documents"), WORDS).orderBy(F.desc("score"), "doc_id").limit(20)
    return R.hybrid_top_k(v, w, 10).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS chunks, count(DISTINCT label) AS labels, max(len(embedding)) AS dimension, sum(4 * len(embedding))::BIGINT AS bytes FROM embeddings")
def g01_index_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("chunks"), F.count_distinct("label").alias("labels"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.sum(F.size("embedding") * 4).alias("bytes"))


@query("SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL")
def s07_text_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != ""))
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"), words.cast("long").alias("words"))


@query("""SELECT doc_id, k - 1 AS index, length(p) AS chars FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s*\\n\\s*', ' ', 'g'))), lambda x: length(x) > 0) AS ps FROM documents)) WHERE length(p) >= 10""")
def s08_paragraphs(spark, sf_dir):
    """Sentence ends become blank lines first: the documents have none of their own."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit("\n\n")))
    p = d.select("doc_id", F.explode(T.paragraphs(F.col("text"), 10)).alias("p"))
    return p.select("doc_id", F.col("p.index").cast("long").alias("index"), F.length("p.text").cast("long").alias("chars"))


@query("""SELECT doc_id, k::BIGINT AS index, (k * 462)::BIGINT AS start, md5(substr(text, (k * 462 + 1)::BIGINT, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 1, 0) // 462) + 1)) AS k FROM documents WHERE text IS NOT NULL) WHERE trim(regexp_replace(substr(text, (k * 462 + 1)::BIGINT, 512), '\\s+', ' ', 'g')) <> ''""")
def c04_fixed_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    w = d.select("doc_id", F.explode(T.fixed_windows(F.col("text"), 512, 50)).alias("w"))
    return w.select("doc_id", F.col("w.index").cast("long").alias("index"), F.col("w.start").cast("long").alias("start"), F.md5("w.text").alias("digest"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def c11_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, len(s)::BIGINT AS sentences, length(list_aggregate(s, 'string_agg', ''))::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS s FROM documents WHERE text IS NOT NULL) WHERE len(s) > 0")
def c10_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.length(F.array_join("s", "")).cast("long").alias("chars"))


@query("SELECT doc_id, substr(md5(source || ':' || substr(text, 1, 100)), 1, 16) AS id FROM documents WHERE text IS NOT NULL")
def m06_document_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.document_id(F.col("source"), F.col("text")).alias("id"))


@query("SELECT page_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\\s\\x{A0}\\x{3000}]+', ' ', 'g')) AS t FROM pages)")
def x10_html_strip(spark, sf_dir):
    t = T.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE contains(text, 'the')")
def f08_note_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the")))
    return d.select("doc_id", T.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS word FROM documents) WHERE length(word) > 1 GROUP BY word")
def g09_word_frequency(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).filter(F.length("word") > 1)
    return w.groupBy("word").agg(F.count("*").alias("n"))
