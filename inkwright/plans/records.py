"""Queries for splitting by packing, summaries and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import splitting as S
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


def _list(values) -> str:
    return "[" + ", ".join(" || ".join(["chr(10)"] * len(v)) if v.strip("\n") == "" else f"'{v}'" for v in values) + "]"


#: Pieces with their places are folded into groups; finished groups wait as text, as a list's fold keeps one type.
_C01 = rf"""WITH d AS (SELECT doc_id, text, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS han, length(regexp_replace(text, '[^぀-ヿ]', '', 'g')) AS kana FROM documents WHERE regexp_matches(text, '\S')),
s AS (SELECT doc_id, text, unnest(seps) AS s, generate_subscripts(seps, 1) AS ord FROM (SELECT *, CASE WHEN kana > 0.1 * han THEN {_list(S.SEPARATORS['japanese'])} ELSE {_list(S.SEPARATORS['general'])} END AS seps FROM d WHERE length(text) > 512)),
l AS (SELECT doc_id, s, ord, string_split(text, s) AS l FROM s),
p AS (SELECT doc_id, ord, list_concat(list_transform(l[1:-2], lambda x: x || s), [l[-1]]) AS pieces FROM l),
best AS (SELECT doc_id, arg_min(pieces, ord) AS pieces FROM p WHERE len(list_filter(pieces, lambda x: length(x) > 512 AND regexp_matches(x, '\S'))) = 0 GROUP BY doc_id),
u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM best),
o AS (SELECT doc_id, pos, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS b FROM u),
f AS (SELECT doc_id, list_reduce(list({{'a': b - length(piece), 'b': b, 'used': length(piece), 'done': ''}} ORDER BY pos), lambda x, y: CASE WHEN x.used + y.used <= 512 THEN {{'a': x.a, 'b': y.b, 'used': x.used + y.used, 'done': x.done}} ELSE {{'a': y.a, 'b': y.b, 'used': y.used, 'done': x.done || x.a || ':' || x.b || ','}} END) AS r FROM o WHERE regexp_matches(piece, '\S') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(string_split(r.done || r.a || ':' || r.b, ',')) AS g, generate_subscripts(string_split(r.done || r.a || ':' || r.b, ','), 1) - 1 AS index FROM f UNION ALL SELECT doc_id, '0:' || length(text), 0 FROM d WHERE length(text) <= 512),
c AS (SELECT doc_id, index, text, string_split(g, ':')[1]::BIGINT AS a, string_split(g, ':')[2]::BIGINT AS b FROM g JOIN d USING (doc_id)),
t AS (SELECT doc_id, index, a + length(body) - length(regexp_replace(body, '^[\s\x0B]+', '')) AS a, a + length(regexp_replace(body, '[\s\x0B]+$', '')) AS b, regexp_replace(body, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS body FROM (SELECT *, substr(text, a + 1, b - a) AS body FROM c)),
w AS (SELECT doc_id, text, a, least(a + 512, length(text)) AS b FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 462)) AS a FROM d WHERE length(text) > 512 AND doc_id NOT IN (SELECT doc_id FROM best)) WHERE regexp_matches(substr(text, a + 1, 512), '\S'))
SELECT doc_id, index::INT AS index, a::INT AS start, b::INT AS stop, COALESCE(CASE WHEN index > 0 THEN least(50, lag(b - a) OVER (PARTITION BY doc_id ORDER BY index)) END, 0)::INT AS overlap, md5(body) AS digest FROM t
UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT, a::INT, b::INT, 0, md5(substr(text, a + 1, b - a)) FROM w"""


@query(_C01)
def c01_recursive_chunks(spark, sf_dir):
    c = S.chunked(table(spark, sf_dir, "documents"), S.recursive_chunks)
    return c.select("doc_id", "index", "start", "stop", F.length("overlap").alias("overlap"), F.md5("body").alias("digest"))


_C07 = r"""WITH u AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+') AS l FROM documents WHERE text <> '')),
o AS (SELECT doc_id, pos, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS b FROM u),
f AS (SELECT doc_id, list_reduce(list({'a': b - length(piece), 'b': b, 'n': length(piece), 'done': ''} ORDER BY pos), lambda x, y: CASE WHEN y.b - x.a > 512 THEN {'a': y.a, 'b': y.b, 'n': y.n, 'done': x.done || x.a || ':' || x.b || ':' || x.n || ','} ELSE {'a': x.a, 'b': y.b, 'n': y.n, 'done': x.done} END) AS r FROM o WHERE regexp_matches(piece, '\S') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(string_split(r.done || r.a || ':' || r.b || ':' || r.n, ',')) AS g, generate_subscripts(string_split(r.done || r.a || ':' || r.b || ':' || r.n, ','), 1) AS k FROM f),
c AS (SELECT doc_id, k, string_split(g, ':')[1]::BIGINT AS a, string_split(g, ':')[2]::BIGINT AS b, string_split(lag(g) OVER (PARTITION BY doc_id ORDER BY k), ':')[3]::BIGINT AS n FROM g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS index, a::INT AS start, b::INT AS stop, COALESCE(n, 0)::INT AS overlap, md5(substr(text, a + 1, b - a)) AS digest FROM c JOIN documents USING (doc_id) WHERE k = 1 OR b - a >= 100"""


@query(_C07)
def c07_sentence_chunks(spark, sf_dir):
    c = S.chunked(table(spark, sf_dir, "documents"), S.sentence_chunks)
    return c.select("doc_id", "index", "start", "stop", F.length("overlap").alias("overlap"), F.md5("body").alias("digest"))


@query("SELECT label, vec_id, sum(fresh) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS segment FROM (SELECT label, vec_id, CASE WHEN list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) < 0.7 THEN 1 ELSE 0 END AS fresh FROM embeddings)")
def c09_similarity_segments(spark, sf_dir):
    return S.similarity_segments(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "segment")


_SENT = "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS place, len(s) AS n FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS s FROM documents)"


@query("WITH s AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '[。！？；\n]+'), lambda x: regexp_replace(x, '^[\\s\\x0B　]+|[\\s\\x0B　]+$', '', 'g')), lambda x: x <> '') AS s FROM (SELECT doc_id, replace(COALESCE(text, ''), '.', '。') AS t FROM documents)), e AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS place, unnest(s) AS x FROM s WHERE len(s) > 5), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(least(1.0, (place < 3)::INT * 0.5 + (place >= n - 2)::INT * 0.3 + contains(x, 'tion')::INT * 0.1 + contains(x, 'The')::INT * 0.1 + (length(x) > 50)::INT * 0.1), 6) DESC, place) AS r FROM e) SELECT doc_id, md5(string_agg(x, ' ' ORDER BY place)) AS digest FROM r WHERE r <= 5 GROUP BY doc_id UNION ALL SELECT doc_id, md5(t) FROM s WHERE len(s) <= 5")
def z06_extractive_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit("。")).alias("text"))
    return U.extractive_summary(d, ("tion", "The")).select("doc_id", F.md5("summary").alias("digest"))


@query("SELECT * FROM (SELECT doc_id, t.name, ((length(text) - length(replace(text, t.name, ''))) // length(t.name) + (length(text) - length(replace(lower(text), t.name, ''))) // length(t.name)) * CASE WHEN contains(substr(text, 1, 500), t.name) THEN 1.5 ELSE 1.0 END AS weight FROM documents, (VALUES ('the'), ('tion'), ('eau')) t(name)) WHERE weight > 0")
def e15_tags(spark, sf_dir):
    t = U.tags(F.col("text"), {"english": ["the", "tion"], "french": ["eau"]})
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(t).alias("t")).select("doc_id", "t.name", F.col("t.weight").cast("double").alias("weight"))


@query(f"SELECT doc_id, round(avg(length(sentence)), 4) AS mean_length, round(avg((length(sentence) >= 60)::INT), 4) AS long_share, round(avg((length(sentence) <= 20)::INT), 4) AS short_share FROM ({_SENT}) GROUP BY doc_id")
def g11_sentence_shape(spark, sf_dir):
    s = table(spark, sf_dir, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", U.sentence_shape(F.col("text"), ["and"]).alias("s"))
    return s.select("doc_id", *[F.round(f"s.{c}", 4).alias(c) for c in ("mean_length", "long_share", "short_share")])


@query("SELECT s_suppkey, fallback FROM (SELECT s_suppkey, s_nationkey, score, max(score) OVER (PARTITION BY s_nationkey) < 0.35 AS fallback, row_number() OVER (PARTITION BY s_nationkey, score >= 0.2 ORDER BY s_suppkey) AS r FROM (SELECT *, s_nationkey / 60.0 + s_suppkey % 5 / 40.0 AS score FROM supplier)) WHERE (NOT fallback AND score >= 0.35) OR (fallback AND score >= 0.2 AND r = 1)")
def z13_plausible_or_best(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumns({"score": F.col("s_nationkey") / 60 + F.col("s_suppkey") % 5 / 40, "ordinal": F.col("s_suppkey")})
    return R.plausible_or_best(s, "s_nationkey", "score").select("s_suppkey", "fallback")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 3 = 0 AND o_orderpriority <> '5-LOW' THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END, o_orderkey) AS r FROM orders) WHERE r = 1")
def t_k16_preferred_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pid = F.when(F.col("o_orderkey") % 3 == 0, F.lit("12345678")).otherwise("x")
    rows = o.select("o_custkey", "o_orderkey", pid.alias("pid"), (F.col("o_orderstatus") == "F").alias("has_pdf"), F.when(F.col("o_orderpriority") == "5-LOW", "html").otherwise("api").alias("route"), F.col("o_orderkey").alias("ordinal"))
    return R.preferred_source(rows, "o_custkey").select("o_custkey", "o_orderkey")


@query("SELECT event_id, round(greatest(0.1, least(0.35 + (event_id % 11) / 10.0 * 0.35 + (event_id % 3) / 2.0 * 0.15 + CASE WHEN event_id % 2 = 0 THEN 0.05 ELSE 0 END - least(0.35, event_id % 8 * 0.06), 0.95)), 6) AS confidence FROM events")
def z27_verification_confidence(spark, sf_dir):
    i = F.col("event_id")
    value = R.verification_confidence((i % 11) / 10, (i % 3) / 2, i % 2 == 0, i % 8, digits=6)
    return table(spark, sf_dir, "events").select("event_id", value.alias("confidence"))
