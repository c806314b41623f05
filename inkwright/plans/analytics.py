"""Queries for dedup, aggregation, windows, graphs and run analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import graph as G
from ..operators import runs as U
from .tables import GRAPH_SQL, graph, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _graph(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return G.with_core(G.degrees(nodes, edges)), edges


_CORE = GRAPH_SQL + ", ranked AS (SELECT *, row_number() OVER (ORDER BY citation_count + cited_by_count DESC, year DESC, id) AS r, count(*) OVER () AS n FROM nodes), core AS (SELECT *, r <= greatest(1, n // 5) AND citation_count + cited_by_count > 0 AS is_core FROM ranked)"


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def w03_first_per_key(spark, sf_dir):
    return D.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, lower(trim(c_mktsegment)) AS name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(c_mktsegment)) ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def w04_best_per_name(spark, sf_dir):
    best = D.keep_best(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", ["c_custkey"])
    return best.select("c_custkey", F.lower(F.trim("c_mktsegment")).alias("name"), "c_acctbal")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w05_last_write(spark, sf_dir):
    return D.keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT key, part, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, id) AS r FROM (SELECT lower(s_name) AS key, 0 AS part, s_suppkey AS id FROM supplier UNION ALL SELECT lower(replace(c_name, 'Customer', 'Supplier')), 1, c_custkey FROM customer)) WHERE r = 1")
def u02_union_distinct(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("key"), F.lit(0).alias("part"), F.col("s_suppkey").alias("id"))
    c = table(spark, sf_dir, "customer").select(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("key"), F.lit(1).alias("part"), F.col("c_custkey").alias("id"))
    return D.union_distinct([s, c], F.col("key"), ["id"])


@query("SELECT user_id, arg_min(event_type, ts_id) FILTER (WHERE event_type <> 'view') AS event_type, arg_min(value, ts_id) AS value FROM (SELECT *, (epoch_us(ts)::HUGEINT * 1000000 + event_id) AS ts_id FROM events) GROUP BY user_id")
def z12_fill_from_later(spark, sf_dir):
    """A view's type counts as blank, so the first other type fills in."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), "value")
    return D.fill_from_later(e, "user_id", "o", ["event_type", "value"])


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) AS r FROM conversations WHERE trim(text) <> '') WHERE r = 1 GROUP BY conv_id")
def g28_merged_lines(spark, sf_dir):
    return D.merged_lines(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


@query("SELECT CASE grouping(lang, source) WHEN 3 THEN 'all' WHEN 1 THEN 'lang' ELSE 'source' END AS level, lang, source, count(*) AS n, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def g03_entity_stats(spark, sf_dir):
    return U.grouping_statistics(table(spark, sf_dir, "documents"), "lang", "source", {"n": F.count("*"), "mean_chars": F.round(F.avg("n_chars"), 3)})


@query("SELECT CASE grouping(task, backend) WHEN 3 THEN 'all' WHEN 1 THEN 'task' ELSE 'backend' END AS level, task, backend, count(*) AS total, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 4) AS mean_time FROM (SELECT event_type AS task, 'user' || (user_id % 5) AS backend, value FROM events) GROUP BY GROUPING SETS ((task), (backend), ())")
def g16_run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.concat(F.lit("user"), F.col("user_id") % 5).alias("backend"), "value")
    measures = {"total": F.count("*"), "success_rate": F.round(F.avg(F.when(F.col("value") >= 10, 1.0).otherwise(0.0)), 6), "mean_time": F.round(F.avg("value"), 4)}
    return U.grouping_statistics(e, "task", "backend", measures)


@query("SELECT category, count(*) AS n, round(avg(c_acctbal), 4) AS mean_confidence, count(*) FILTER (WHERE c_acctbal < 0) AS review FROM (SELECT c_mktsegment AS category, c_acctbal FROM customer) GROUP BY ROLLUP (category)")
def g18_dictionary_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), "c_acctbal")
    return c.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_confidence"), F.count_if(F.col("c_acctbal") < 0).alias("review"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE value < 5) AS review, round(avg(value), 4) AS mean_confidence, bool_or(value < 0.001) AS any_review FROM events")
def g20_payload_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("records"), F.count_if(F.col("value") < 5).alias("review"), F.round(F.avg("value"), 4).alias("mean_confidence"), F.bool_or(F.col("value") < 0.001).alias("any_review"))


@query("SELECT * FROM (PIVOT (SELECT lang, source, n_chars FROM documents WHERE source IN ('src0', 'src1', 'src2')) ON source IN ('src0', 'src1', 'src2') USING count(*) GROUP BY lang)")
def g14_status_pivot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1", "src2"))
    return d.groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().fillna(0)


@query("SELECT conv_id, turn, is_new FROM (SELECT conv_id, turn, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS is_new FROM conversations)")
def w06_change_points(spark, sf_dir):
    return U.change_points(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role").select("conv_id", "turn", "is_new")


@query("SELECT conv_id, turn, CASE WHEN i < 3 THEN 1.0 WHEN i < n * 0.2 THEN 0.8 WHEN i > n * 0.8 THEN 0.7 ELSE 0.5 END::DOUBLE AS position_score FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def w11_sentence_position(spark, sf_dir):
    return U.sentence_positions(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "position_score")


@query("SELECT label, n::BIGINT AS n, first, last FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, last - first DESC, last DESC, first DESC) AS r FROM (SELECT a.label, a.vec_id AS first, count(*) AS n, max(b.vec_id) AS last FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id BETWEEN a.vec_id AND a.vec_id + 15 GROUP BY a.label, a.vec_id)) WHERE r = 1")
def w08_page_cluster(spark, sf_dir):
    return U.page_cluster(table(spark, sf_dir, "embeddings"), "label", "vec_id", 16)


_PAIRS = "SELECT user_id, prev AS started_at, ts AS completed_at, round(epoch_us(ts - prev) / 1000000.0, 3) AS seconds FROM (SELECT user_id, ts, event_type, lag(event_type) OVER w AS pk, lag(ts) OVER w AS prev FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND pk = 'view'"


@query(_PAIRS)
def t01_event_pairs(spark, sf_dir):
    pairs = U.paired_events(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "ts", "view", "purchase")
    return pairs.withColumn("seconds", F.round("seconds", 3))


@query(f"SELECT * FROM ({_PAIRS}) WHERE seconds >= 86400")
def f18_slow_events(spark, sf_dir):
    pairs = U.paired_events(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "ts", "view", "purchase")
    return U.slow_events(pairs, 86400).withColumn("seconds", F.round("seconds", 3))


@query(f"WITH {GRAPH_SQL} SELECT id, citation_count, cited_by_count FROM nodes")
def g05_degrees(spark, sf_dir):
    return G.degrees(*graph(spark, sf_dir)).select("id", "citation_count", "cited_by_count")


@query(f"WITH {_CORE} SELECT id, is_core FROM core")
def w02_core_flag(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("id", "is_core")


@query(f"WITH {_CORE} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) FILTER (WHERE is_core) AS core, count(*) FILTER (WHERE citation_count = 0 AND cited_by_count = 0) AS orphans FROM core")
def g06_graph_summary(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    total = edges.agg(F.count("*").alias("edges")).first()["edges"]
    return nodes.agg(F.count("*").alias("nodes"), F.lit(total).alias("edges"), F.count_if("is_core").alias("core"), F.count_if((F.col("citation_count") == 0) & (F.col("cited_by_count") == 0)).alias("orphans"))


@query(f"WITH {_CORE} SELECT 'key' AS kind, id FROM core WHERE is_core UNION ALL SELECT 'orphan', id FROM core WHERE citation_count = 0 AND cited_by_count = 0")
def g06_marked_nodes(spark, sf_dir):
    return G.marked_nodes(_graph(spark, sf_dir)[0])


@query(f"WITH {GRAPH_SQL} SELECT count(*) AS works, count(*) FILTER (WHERE citation_count = 0 AND cited_by_count = 0) AS isolated, (SELECT count(*) FROM edges) AS edges, (SELECT round(avg(0.5 + source % 4 / 8.0), 6) FROM edges) AS mean_confidence, round((SELECT count(*) FROM edges) / count(*), 6) AS edges_per_work FROM nodes")
def g07_citation_statistics(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    s = G.citation_statistics(G.degrees(nodes, edges), edges.withColumn("confidence", 0.5 + F.col("source") % 4 / 8))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "edges_per_work")})


_SUB = "SELECT user_id, event_type, started_at, completed_at, seconds FROM (SELECT user_id, event_type, lag(ts) OVER w AS started_at, ts AS completed_at, epoch_us(ts - lag(ts) OVER w) / 1e6 AS seconds, row_number() OVER w AS r FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE r % 2 = 0"


@query(f"WITH pairs AS ({_PAIRS}), sub AS ({_SUB}), held AS (SELECT p.user_id, p.completed_at, s.event_type, s.seconds, s.completed_at AS done FROM pairs p JOIN sub s ON s.user_id = p.user_id AND s.started_at >= p.started_at AND s.completed_at <= p.completed_at) SELECT p.user_id, p.completed_at, COALESCE(n, 0) AS subphases, COALESCE(longest, '') AS longest, COALESCE(l, '') AS last FROM pairs p LEFT JOIN (SELECT user_id, completed_at, count(*) AS n, arg_max(event_type, row(seconds, done, event_type)) AS longest, arg_max(event_type, row(done, event_type)) AS l FROM held GROUP BY 1, 2) h ON h.user_id = p.user_id AND h.completed_at = p.completed_at")
def t01_subphases(spark, sf_dir):
    """Every second click or error of a user ends the sub-phase that the one before began."""
    e = table(spark, sf_dir, "events")
    pairs = U.paired_events(e, ["user_id"], ["ts", "event_id"], "event_type", "ts", "view", "purchase")
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    marked = e.filter(F.col("event_type").isin("click", "error")).withColumn("side", F.when(F.row_number().over(by) % 2 == 1, "start").otherwise("stop"))
    sub = U.paired_events(marked, ["user_id", "event_type"], ["ts", "event_id"], "side", "ts", "start", "stop").withColumnRenamed("event_type", "subphase")
    out = U.with_subphases(pairs, sub, ["user_id"]).select("user_id", "completed_at", "subphases", "longest", "last")
    return out.fillna(0, ["subphases"]).fillna("", ["longest", "last"])


@query(f"WITH {GRAPH_SQL} SELECT id, title, cited_by_count FROM nodes ORDER BY cited_by_count DESC, id LIMIT 10")
def g07_most_cited(spark, sf_dir):
    return G.degrees(*graph(spark, sf_dir)).orderBy(F.desc("cited_by_count"), "id").limit(10).select("id", "title", "cited_by_count")


@query(f"WITH {_CORE} SELECT year, count(*) AS works_count, sum(citation_count)::BIGINT AS total_citations, count(*) FILTER (WHERE is_core) AS foundational, array_to_string(list_slice(list(title ORDER BY cited_by_count DESC, title), 1, 3), '|') AS key_works FROM core GROUP BY year")
def g08_evolution(spark, sf_dir):
    return G.evolution(_graph(spark, sf_dir)[0]).select("year", "works_count", "total_citations", F.size("foundational_works").cast("long").alias("foundational"), F.array_join("key_works", "|").alias("key_works"))


@query(f"WITH {GRAPH_SQL}, founders AS (SELECT id FROM nodes ORDER BY cited_by_count DESC, citation_count DESC, id LIMIT 5) SELECT DISTINCT f.id AS founder, m AS member FROM founders f JOIN (SELECT source AS s, target AS m FROM edges UNION SELECT target, source FROM edges) ON s = f.id")
def t_k8_schools(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return G.schools(G.degrees(nodes, edges), edges)


@query(f"WITH {GRAPH_SQL} SELECT id, round((citation_count + cited_by_count) / (2.0 * (SELECT count(*) FROM nodes)), 8) AS centrality, round(least(CASE WHEN citation_count > 0 THEN cited_by_count / citation_count ELSE cited_by_count * 0.5 END, 1.0), 6) AS novelty FROM nodes")
def r33_centrality(spark, sf_dir):
    return G.centrality(G.degrees(*graph(spark, sf_dir))).select("id", F.round("centrality", 8).alias("centrality"), F.round("novelty", 6).alias("novelty"))


@query(f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE cited_by_count > 0 AND (citation_count + cited_by_count) / (2.0 * (SELECT count(*) FROM nodes)) < 0.1 ORDER BY least(CASE WHEN citation_count > 0 THEN cited_by_count / citation_count ELSE cited_by_count * 0.5 END, 1.0) DESC, id LIMIT 10")
def t_k9_peripheral(spark, sf_dir):
    return G.peripheral(G.degrees(*graph(spark, sf_dir))).select("id")


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT s AS id, m AS neighbour FROM (SELECT source AS s, target AS m FROM edges UNION SELECT target, source FROM edges)")
def u05_neighbours(spark, sf_dir):
    _, e = graph(spark, sf_dir)
    return e.select(F.col("source").alias("id"), F.col("target").alias("neighbour")).union(e.select("target", "source")).distinct()


@query("SELECT title, count(*) AS backlinks FROM (SELECT DISTINCT n.r_name AS linked_from, s.n_name AS title FROM nation s JOIN region n ON s.n_regionkey = n.r_regionkey) GROUP BY title")
def j15_backlinks(spark, sf_dir):
    """Regions as notes that link to their nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    link = F.concat(F.lit("see [["), F.col("n_name"), F.lit("]]"))
    notes = n.groupBy(F.col("r_name").alias("title")).agg(F.array_join(F.collect_list(link), " ").alias("text"))
    return G.backlinks(notes).groupBy("title").agg(F.count("*").alias("backlinks"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def u07_missing(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(found, "p_partkey", "left_anti")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 7000 AND contains(lower(c_name), '1')")
def f05_f06_confident_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter((F.col("c_acctbal") >= 7000) & F.contains(F.lower("c_name"), F.lit("1")))
    return c.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_nationkey AS batch_of, s_suppkey, ((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3)::BIGINT AS batch FROM supplier")
def c17_batches(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch_of"), "s_suppkey", F.floor((rn - 1) / 3).alias("batch"))


@query("SELECT user_id, window_start, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT user_id, value, date_trunc('day', ts) AS window_start FROM events) GROUP BY ALL")
def ext_daily_windows(spark, sf_dir):
    """An extension: tumbling windows, which the inventory itself has none of."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")
