"""Queries for sinks, round trips and streams: what is written is read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import runs as U
from ..sources import writers
from ..streaming import progress
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def place(spark, name: str) -> str:
    """A new path under the folder that the cluster shares; a temporary one only on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT vec_id AS chunk_id, vec_id % 50 AS document_id, len(embedding)::INT AS dimension FROM embeddings WHERE vec_id % 50 <> 7")
def k01_k02_index_round_trip(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("document_id"), "embedding")
    writers.save_index(chunks, chunks.select("document_id").distinct(), path := place(spark, "index"))
    gone = spark.createDataFrame([(7,)], "document_id long")
    kept, _ = writers.removed(*writers.load_index(spark, path), gone)
    return kept.select("chunk_id", "document_id", F.size("embedding").alias("dimension"))


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS nation, '' AS region FROM nation UNION ALL SELECT r_name, '', r_regionkey::VARCHAR FROM region")
def k06_csv_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    writers.export_csv([n, r], path := place(spark, "csv"))
    return spark.read.option("header", True).csv(path).fillna("")


@query("SELECT '<node id=\"' || n_nationkey || '\" label=\"' || n_name || '\"/>' AS value FROM nation UNION ALL SELECT '<edge source=\"' || n_nationkey || '\" target=\"' || n_regionkey || '\"/>' FROM nation")
def k07_gexf(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes, edges = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), n.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))
    writers.export_graph(nodes, edges, path := place(spark, "graph"), "gexf")
    return spark.read.text(path)


@query("SELECT '| name | region |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation")
def k17_markdown_table(spark, sf_dir):
    cells = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("c"))))
    rows = F.concat(F.array(F.array(F.lit("name"), F.lit("region"))), F.transform(cells, lambda x: x["c"]))
    return table(spark, sf_dir, "nation").agg(rows.alias("r")).select(writers.markdown_table(F.col("r")).alias("md"))


@query("SELECT user_id::VARCHAR AS key, count(*) AS pairs, round(sum(epoch_us(ts - prev)) / 1000000.0, 2) AS seconds FROM (SELECT user_id, ts, event_type, lag(event_type) OVER w AS pk, lag(ts) OVER w AS prev FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND pk = 'view' GROUP BY user_id")
def t01_stream_pairs(spark, sf_dir):
    """The batch pairing as a stream over the same rows, drained and read back."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts")).filter(F.col("kind").isin("view", "purchase"))
    rows.write.parquet(source := place(spark, "events"))
    stream = progress.paired_stream(progress.event_stream(spark, source, rows.schema.simpleString()[7:-1].replace(":", " ")), "view", "purchase")
    sink = place(spark, "pairs")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(progress.PAIR).parquet(sink)
    return done.groupBy("key").agg(F.count("*").alias("pairs"), F.round(F.sum("seconds"), 2).alias("seconds"))


#: Progress events from the table: views begin, purchases end; of the other kinds even ids begin a sub-phase and odd ones end it.
_PROGRESS = """events_ AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'verify' ELSE '' END AS phase, CAST(user_id AS VARCHAR) AS candidate, event_id AS ordinal, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'late' END AS status,
 CASE WHEN event_type = 'view' THEN 'candidate_started' WHEN event_type = 'purchase' THEN 'candidate_completed' WHEN event_id % 2 = 0 THEN 'worker_stage_started' WHEN event_type = 'error' THEN 'worker_stage_failed' ELSE 'worker_stage_completed' END AS kind,
 CASE WHEN event_type IN ('view', 'purchase') THEN '' WHEN event_type = 'signup' THEN 'volume_series_fulltext_review' ELSE event_type END AS subphase FROM events)"""
_REPORTS = f"""WITH {_PROGRESS}, lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts FROM events_ WINDOW w AS (PARTITION BY candidate, subphase ORDER BY ordinal)),
marked AS (SELECT *, subphase <> '' AND kind <> 'worker_stage_started' AND pk = 'worker_stage_started' AS ended, subphase = 'volume_series_fulltext_review' AS wraps, epoch_us(ts - pts) / 1000000.0 AS s FROM lagged),
seen AS (SELECT *, count(*) FILTER (ended) OVER k AS subphases, count(*) FILTER (ended AND NOT wraps) OVER k AS leaves,
 arg_max(row(subphase, s), row(CASE WHEN s = 0 THEN -1 ELSE s END, -ordinal)) FILTER (ended AND NOT wraps) OVER k AS ll, arg_max(row(subphase, s), row(CASE WHEN s = 0 THEN -1 ELSE s END, -ordinal)) FILTER (ended AND wraps) OVER k AS wl,
 arg_max(row(subphase, status), ordinal) FILTER (ended AND NOT wraps) OVER k AS lf, arg_max(row(subphase, status), ordinal) FILTER (ended AND wraps) OVER k AS wf, arg_max(row(subphase, status), ordinal) FILTER (subphase <> '') OVER k AS told
 FROM marked WINDOW k AS (PARTITION BY candidate ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
named AS (SELECT *, CASE WHEN phase = '' THEN 'candidate' ELSE phase END || '_total' AS total FROM seen WHERE kind = 'candidate_completed' AND pk = 'candidate_started')
SELECT phase, '' AS position, candidate, status, pts AS started_at, ts AS completed_at, s AS seconds, subphases, CASE WHEN leaves > 0 THEN ll[1] WHEN subphases > 0 THEN wl[1] WHEN told IS NULL THEN total END AS longest,
 CASE WHEN leaves > 0 THEN ll[2] WHEN subphases > 0 THEN wl[2] WHEN told IS NULL THEN s END AS longest_seconds, CASE WHEN leaves > 0 THEN lf[1] WHEN subphases > 0 THEN wf[1] WHEN told IS NULL THEN total ELSE told[1] END AS last,
 CASE WHEN leaves > 0 THEN lf[2] WHEN subphases > 0 THEN wf[2] WHEN told IS NULL THEN status ELSE told[2] END AS last_status FROM named"""


def _progress(spark, sf_dir):
    e, odd = table(spark, sf_dir, "events"), F.col("event_id") % 2 == 1
    kind = F.when(F.col("event_type") == "view", U.STARTED).when(F.col("event_type") == "purchase", U.FINISHED).when(~odd, U.STAGE_STARTED).when(F.col("event_type") == "error", U.STAGE_FINISHED[1]).otherwise(U.STAGE_FINISHED[0])
    subphase = F.when(F.col("event_type").isin("view", "purchase"), "").when(F.col("event_type") == "signup", U.WRAPPERS[0]).otherwise(F.col("event_type"))
    phase = F.when(F.col("user_id") % 2 == 0, "verify").otherwise("")
    return e.select(phase.alias("phase"), F.lit("").alias("position"), F.col("user_id").cast("string").alias("candidate"), kind.alias("kind"), subphase.alias("subphase"), F.when(F.col("event_id") % 3 == 0, "ok").otherwise("late").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ordinal"))


@query(_REPORTS)
def t01_phase_reports(spark, sf_dir):
    out = U.phase_reports(_progress(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")})


@query(_REPORTS)
def t01_stream_reports(spark, sf_dir):
    """The same reports from a stream over the same rows, drained and read back."""
    rows = _progress(spark, sf_dir)
    rows.write.parquet(source := place(spark, "progress"))
    progress.durable_state(spark)
    stream, sink = progress.reported_stream(spark.readStream.schema(rows.schema).parquet(source)), place(spark, "reports")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(stream.schema).parquet(sink)
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")})


def _put(spark, path: str, text: str) -> None:
    """A small file, written through Spark's own file system layer so that executors can read it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
