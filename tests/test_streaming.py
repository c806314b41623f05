import datetime as dt
import tempfile

from inkwright.operators import runs
from inkwright.streaming import progress

SCHEMA = "key string, kind string, ts timestamp"


def drained(spark, stream):
    sink = tempfile.mkdtemp(prefix="spark-")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def source(spark, batches):
    path = tempfile.mkdtemp(prefix="spark-")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_a_start_without_completion_times_out_once(spark):
    batches = [[("a", "started", at(0)), ("b", "started", at(0))], [("b", "completed", at(2))], [("c", "started", at(90))], [("c", "completed", at(91))], [("d", "started", at(200))], [("d", "completed", at(201))]]
    stream = progress.paired_stream(source(spark, batches).withWatermark("ts", "1 second"), timeout_seconds=600)
    rows = {(r["key"], r["status"]): r for r in drained(spark, stream).collect()}
    assert set(rows) == {("a", "timeout"), ("b", "completed"), ("c", "completed"), ("d", "completed")}
    assert rows["b", "completed"]["seconds"] == 120 and rows["a", "timeout"]["completed_at"] is None


def test_windowed_counts_wait_for_the_watermark(spark):
    batches = [[("a", "view", at(1)), ("a", "view", at(2)), ("b", "buy", at(3))], [("a", "view", at(300))], [("a", "view", at(600))]]
    rows = drained(spark, progress.windowed_counts(source(spark, batches))).collect()
    assert {(r["kind"], r["window"]["start"].hour, r["n"]) for r in rows} >= {("view", 0, 2), ("buy", 0, 1)}


EVENTS = "phase string, position string, candidate string, kind string, subphase string, status string, ts timestamp, ordinal long"
#: kind, sub-phase, status, minute; a key's rows in order.
TOLD = [
    ("candidate_started", "", None, 0),
    ("candidate_started", "", None, 1),
    ("worker_stage_started", "search", None, 2),
    ("worker_stage_completed", "search", "ok", 5),
    ("worker_stage_completed", "search", "again", 6),
    ("worker_stage_started", "volume_series_fulltext_review", None, 6),
    ("worker_stage_completed", "volume_series_fulltext_review", "ok", 60),
    ("candidate_completed", "", "verified", 61),
    ("candidate_completed", "", "stray", 62),
    ("candidate_started", "", None, 70),
    ("worker_stage_started", "read", None, 70),
    ("worker_stage_failed", "read", "failed", 73),
    ("candidate_completed", "", "failed", 80),
]


def progress_rows(candidate, told, first=0, phase="verify"):
    return [(phase, "1", candidate, k, s, status, None if m is None else at(m), first + i) for i, (k, s, status, m) in enumerate(told)]


def short(rows):
    return sorted((r["candidate"], r["status"], r["seconds"], r["subphases"], r["longest"], r["longest_seconds"], r["last"], r["last_status"]) for r in rows)


def test_reports_add_up_over_a_keys_pairs(spark):
    rows = progress_rows("a", TOLD)
    rows += progress_rows("b", [("candidate_started", "", None, 0), ("candidate_completed", "", "done", 9)], phase=None)
    rows += progress_rows("c", [("candidate_started", "", None, 0), ("worker_stage_started", "read", "open", 1), ("worker_stage_noted", "list", "noted", 2), ("candidate_completed", "", "done", 9)])
    rows += progress_rows("d", [("candidate_started", "", None, 0), ("worker_stage_started", "volume_series_fulltext_review", None, 1), ("worker_stage_failed", "volume_series_fulltext_review", "x", 2), ("candidate_completed", "", "done", 9)])
    rows += progress_rows("e", [("candidate_started", "", None, None), ("candidate_completed", "", "done", 9)])
    rows += progress_rows("f", [("candidate_started", "", None, 0), ("worker_stage_started", "read", None, None), ("worker_stage_completed", "read", "ok", 2), ("candidate_completed", "", "done", 9)])
    wanted = sorted([
        ("a", "verified", 3600.0, 2, "search", 180.0, "search", "ok"),
        ("a", "failed", 600.0, 3, "search", 180.0, "read", "failed"),
        ("b", "done", 540.0, 0, "candidate_total", 540.0, "candidate_total", "done"),
        ("c", "done", 540.0, 0, None, None, "list", "noted"),
        ("d", "done", 540.0, 1, "volume_series_fulltext_review", 60.0, "volume_series_fulltext_review", "x"),
        ("f", "done", 540.0, 1, None, None, "read", "ok"),
    ])
    df = spark.createDataFrame(rows, EVENTS)
    assert short(runs.phase_reports(df).collect()) == wanted
    assert short(runs.phase_reports(df.repartition(3, "kind")).collect()) == wanted
    assert runs.phase_reports(df.limit(0)).collect() == []
    progress.durable_state(spark)
    path = tempfile.mkdtemp(prefix="spark-")
    df.write.mode("append").parquet(path)
    got = drained(spark, progress.reported_stream(spark.readStream.schema(EVENTS).parquet(path))).collect()
    assert short(got) == wanted


def test_reports_go_on_after_a_restart(spark):
    """The stream is stopped and started anew within a pair and within a sub-phase; its state comes from the checkpoint."""
    progress.durable_state(spark)
    path, sink, kept = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    rows = progress_rows("a", TOLD)
    for part in (rows[:3], rows[3:11], rows[11:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
        stream = progress.reported_stream(spark.readStream.schema(EVENTS).parquet(path))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(sink).collect()
    assert short(got) == short(runs.phase_reports(spark.createDataFrame(rows, EVENTS)).collect()) and len(got) == 2


def test_timeouts_stay_open_until_a_later_report(spark):
    progress.durable_state(spark)
    begin, end = ("candidate_started", "", None), ("candidate_completed", "", "done")
    batches = [progress_rows("a", [(*begin, 0)]) + progress_rows("b", [(*begin, 0)]), progress_rows("x", [(*begin, 90), (*end, 91)]), progress_rows("b", [(*begin, 92), (*end, 93)], 5), progress_rows("y", [(*begin, 300), (*end, 301)]), progress_rows("y", [(*begin, 600), (*end, 601)], 5)]
    path = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "1 second")
    got = drained(spark, progress.reported_stream(events, 600))
    told = sorted((r["candidate"], r["status"]) for r in got.collect())
    assert told == [("a", "timeout"), ("b", "done"), ("b", "timeout"), ("x", "done"), ("y", "done"), ("y", "done")]
    assert [r["candidate"] for r in progress.open_timeouts(got).collect()] == ["a"]
