"""Run analytics: pairing of events, change points, grouping-set statistics, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_events(events: DataFrame, keys: list[str], order: list[str], kind: str, time: str, started: str, completed: str) -> DataFrame:
    """(keys, started_at, completed_at, seconds): each completion with the start just before it of its key.

    A second start replaces the first; a start serves one completion; what has no partner goes. So a completion counts
    exactly if the row before it, among starts and completions of its key, is a start.
    """
    rows = events.filter(F.col(kind).isin(started, completed))
    before = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({"_kind": F.lag(kind).over(before), "_at": F.lag(time).over(before)})
    pairs = rows.filter((F.col(kind) == completed) & (F.col("_kind") == started))
    seconds = F.col(time).cast("timestamp").cast("double") - F.col("_at").cast("timestamp").cast("double")
    return pairs.select(*keys, F.col("_at").alias("started_at"), F.col(time).alias("completed_at"), seconds.alias("seconds"))


def with_subphases(pairs: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the longest and the last sub-phase (keys, subphase, started_at, completed_at, seconds) that lies within each of them.

    A key's pairs follow one another, so a sub-phase can only belong to the next pair that ends: a running value, not a join of ranges.
    """
    none = F.lit(None)
    ends = pairs.select(*keys, F.col("completed_at").alias("_at"), F.lit(1).alias("_end"), F.struct("started_at", "completed_at").alias("_pair"), none.cast("string").alias("subphase"), none.cast("timestamp").alias("_begin"), none.cast("double").alias("seconds"))
    inner = phases.select(*keys, F.col("completed_at").alias("_at"), F.lit(0).alias("_end"), F.lit(None).cast(ends.schema["_pair"].dataType).alias("_pair"), "subphase", F.col("started_at").cast("timestamp").alias("_begin"), "seconds")
    after = Window.partitionBy(*keys).orderBy("_at", "_end").rowsBetween(0, Window.unboundedFollowing)
    rows = ends.unionByName(inner).withColumn("_pair", F.first("_pair", ignorenulls=True).over(after))
    held = rows.filter("_end = 0 AND _pair IS NOT NULL AND _begin >= _pair.started_at")
    longest = F.max_by("subphase", F.struct("seconds", "_at", "subphase"))
    best = held.groupBy(*keys, F.col("_pair.completed_at").alias("completed_at")).agg(F.count("*").alias("subphases"), longest.alias("longest"), F.max_by("subphase", F.struct("_at", "subphase")).alias("last"))
    return pairs.join(best, [*keys, "completed_at"], "left")


#: Kinds of progress events, and sub-phases that only hold others.
STARTED, FINISHED = "candidate_started", "candidate_completed"
STAGE_STARTED, STAGE_FINISHED = "worker_stage_started", ("worker_stage_completed", "worker_stage_failed")
WRAPPERS = ("volume_series_fulltext_review",)
#: What a progress event belongs to.
PHASE_KEYS = ["phase", "position", "candidate"]


def phase_reports(events: DataFrame) -> DataFrame:
    """(keys, status, started_at, completed_at, seconds, subphases, longest, longest_seconds, last, last_status): one report of every completed start.

    events: (phase, position, candidate, kind, subphase, status, ts, ordinal), where ordinal is the order of a key's rows. A later start replaces an
    open one, and ends without a start go, for candidates as for sub-phases. A key's sub-phases add up over its pairs: a report counts
    all that ended before it. The longest (the first of equals; one without a time never) and the last are taken among leaves, or among wrappers where no leaf
    ended; else the last sub-phase told of is the last; without any, the phase as a whole is both. Null keys count as empty.
    """
    rows = events.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*PHASE_KEYS, "kind", "subphase"]})
    stage = (F.col("subphase") != "") & F.startswith("kind", F.lit("worker_stage_"))
    rows = rows.filter(stage | F.col("kind").isin(STARTED, FINISHED)).withColumn("_stage", stage)
    paired = F.col("kind").isin(STARTED, FINISHED, STAGE_STARTED, *STAGE_FINISHED)
    lane = F.when(F.col("_stage") & paired, F.col("subphase")).when(paired, "").otherwise(None)
    before = Window.partitionBy(*PHASE_KEYS, "_stage", "_lane").orderBy("ordinal")
    rows = rows.withColumn("_lane", lane).withColumns({"_kind": F.lag("kind").over(before), "_at": F.lag("ts").over(before)})
    ended = F.col("_stage") & F.col("kind").isin(*STAGE_FINISHED) & (F.col("_kind") == STAGE_STARTED)
    rows = rows.withColumns({"_s": (F.unix_micros("ts") - F.unix_micros("_at")) / F.lit(1e6), "_ended": F.coalesce(ended, F.lit(False)), "_leaf": ~F.col("subphase").isin(*WRAPPERS)})

    sofar = Window.partitionBy(*PHASE_KEYS).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    name = F.struct("subphase", F.col("_s").alias("seconds"), "status")
    weight = F.struct(F.when(F.col("_s") == 0, -1.0).otherwise(F.col("_s")), -F.col("ordinal"))

    def over(side: Column) -> tuple[Column, Column]:
        timed = side & F.col("_s").isNotNull()
        return F.max_by(F.when(timed, name), F.when(timed, weight)).over(sofar), F.last(F.when(side, name), ignorenulls=True).over(sofar)

    leaf, wrapper = over(F.col("_ended") & F.col("_leaf")), over(F.col("_ended") & ~F.col("_leaf"))
    told = F.last(F.when(F.col("_stage"), name), ignorenulls=True).over(sofar)
    rows = rows.withColumns({"subphases": F.count_if("_ended").over(sofar), "_ll": leaf[0], "_lf": leaf[1], "_wl": wrapper[0], "_wf": wrapper[1], "_told": told})
    done = rows.filter(F.col("kind").eqNullSafe(FINISHED) & (F.col("_kind") == STARTED) & F.col("_s").isNotNull())
    total = F.struct(F.concat(F.when(F.col("phase") == "", "candidate").otherwise(F.col("phase")), F.lit("_total")).alias("subphase"), F.col("_s").alias("seconds"), "status")
    longest = F.when(F.col("_lf").isNotNull(), F.col("_ll")).when(F.col("_wf").isNotNull(), F.col("_wl")).when(F.col("_told").isNull(), total)
    last = F.coalesce("_lf", "_wf", "_told", total)
    done = done.withColumns({"_longest": longest, "_last": last})
    return done.select(*PHASE_KEYS, "status", F.col("_at").alias("started_at"), F.col("ts").alias("completed_at"), F.col("_s").alias("seconds"), "subphases", F.col("_longest.subphase").alias("longest"), F.col("_longest.seconds").alias("longest_seconds"), F.col("_last.subphase").alias("last"), F.col("_last.status").alias("last_status"))


def slow_events(pairs: DataFrame, threshold: float = 240.0) -> DataFrame:
    return pairs.filter(F.col("seconds") >= threshold)


def change_points(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """is_new: a value that differs from the last one before it that wasn't null or blank; blank values are never new."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.trim(F.col(value)) != "", F.col(value))
    previous = F.last(filled, ignorenulls=True).over(window)
    return rows.withColumns({"previous": previous, "is_new": filled.isNotNull() & ~filled.eqNullSafe(previous)})


def grouping_statistics(rows: DataFrame, first: str, second: str, measures: dict[str, Column]) -> DataFrame:
    """One pass for statistics by `first`, by `second` and over all, with the level that a row is for."""
    sets = rows.groupingSets([[first], [second], []], first, second)
    level = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, first).otherwise(second)
    return sets.agg(level.alias("level"), *[c.alias(n) for n, c in measures.items()])


def required_fields(required: list[str]) -> tuple[Column, Column]:
    """(missing, confidence): required fields that are null or blank, and the share that isn't."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))
    return missing, (len(required) - F.size(missing)) / F.lit(float(len(required)))


def status_class(status: Column, has_pdf: Column, has_hits: Column, mismatch: Column) -> Column:
    """One status by precedence: an explicit mismatch, then evidence, then what was found, then nothing."""
    return (
        F.when(mismatch, "source_mismatch")
        .when((status == "verified") & has_pdf, "verified_with_source")
        .when(has_hits, "source_found")
        .when(status == "pending", "pending")
        .otherwise("source_not_found")
    )


def package_confidence(total_nodes: Column, total_edges: Column, key_sources: Column, edge_confidence: Column, flags: Column) -> Column:
    value = F.lit(0.45) + F.when(total_edges > 0, 0.25).otherwise(0.0) + F.when(key_sources > 0, 0.10).otherwise(0.0)
    value = value + F.least(F.lit(0.15), edge_confidence * 0.15) - F.least(F.lit(0.25), flags * 0.08)
    return F.when(total_nodes == 0, 0.2).otherwise(F.round(F.greatest(F.lit(0.1), F.least(value, F.lit(0.95))), 2))


def review_queue(packages: DataFrame) -> DataFrame:
    """One row per package and distinct flag."""
    return packages.select("package_id", F.explode(F.array_distinct("quality_flags")).alias("flag"))


def sentence_positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """position_score: first three 1.0, first fifth 0.8, last fifth 0.7, else 0.5."""
    index = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy(group))
    score = F.when(F.col("index") < 3, 1.0).when(F.col("index") < F.col("total") * 0.2, 0.8).when(F.col("index") > F.col("total") * 0.8, 0.7).otherwise(0.5)
    return rows.withColumns({"index": index, "total": total}).withColumn("position_score", score)


def page_cluster(numbers: DataFrame, group: str, value: str, width: int) -> DataFrame:
    """The run of `width` page numbers with the most entries; then the widest spread, then the highest."""
    frame = Window.partitionBy(group).orderBy(value).rangeBetween(0, width - 1)
    runs = numbers.select(group, F.col(value).alias("first"), F.count("*").over(frame).alias("n"), F.max(value).over(frame).alias("last"))
    best = F.max(F.struct("n", (F.col("last") - F.col("first")).alias("spread"), "last", "first"))
    return runs.groupBy(group).agg(best.alias("b")).select(group, "b.n", "b.first", "b.last")
