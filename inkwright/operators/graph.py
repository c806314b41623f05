"""Citation and note graphs: edges, degrees, core works, schools, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wiki_links

TITLE_WORD = "[A-Za-z一-鿿]{4,}"


def citation_edges(docs: DataFrame) -> DataFrame:
    """(source, target, confidence): two or more title words occur in the source's text; a word that a title repeats counts again.

    `docs`: id, title, text. A title word may be part of a longer word. Of each length that title words have, a text gives all its parts, each once, and
    these meet the words by equality, so no text meets a word that it does not hold.
    """
    titles = docs.select(F.col("id").alias("target"), F.explode(F.transform(F.regexp_extract_all("title", F.lit(f"({TITLE_WORD})"), 1), lambda w: F.lower(w))).alias("word"))
    words = titles.groupBy("target", "word").agg(F.count("*").alias("times"))
    lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect())  # one number for each length
    letter = TITLE_WORD.removesuffix("{4,}")
    parts = [F.regexp_extract_all("_t", F.lit(f"(?=({letter}{{{n}}}))"), 1) for n in lengths] or [F.array().cast("array<string>")]
    # Texts give many parts each, so they are dealt anew: a table in one file would else be read and taken apart by one task.
    texts = docs.select(F.col("id").alias("source"), F.lower(F.coalesce("text", F.lit(""))).alias("_t")).repartition("source")
    held = texts.select("source", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("word"))
    # Which words a text has, once each, before titles come in.
    seen = held.join(words.select("word"), "word", "left_semi").distinct()
    hits = seen.join(words, "word").filter("source <> target")
    overlap = hits.groupBy("source", "target").agg(F.sum("times").alias("overlap")).filter("overlap >= 2")
    return overlap.select("source", "target", F.least(F.lit(0.9), 0.4 + 0.15 * F.col("overlap")).alias("confidence"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with citation_count (out) and cited_by_count (in)."""
    out = edges.groupBy(F.col("source").alias(key)).agg(F.count("*").alias("citation_count"))
    into = edges.groupBy(F.col("target").alias(key)).agg(F.count("*").alias("cited_by_count"))
    joined = nodes.join(out, key, "left").join(into, key, "left")
    return joined.fillna(0, ["citation_count", "cited_by_count"])


def with_core(nodes: DataFrame, key: str = "id", year: str = "year") -> DataFrame:
    """is_core: in the top fifth by degree, then year (at least one node), with a degree above 0.

    The cut is found on the histogram of (degree, year), so no task sorts all nodes; ties at the cut go by key.
    """
    degree = F.col("citation_count") + F.col("cited_by_count")
    rows = nodes.withColumn("_degree", degree)
    groups = rows.groupBy("_degree", year).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc("_degree"), F.desc(year))
    ahead = groups.select(F.col("_degree").alias("_d"), F.col(year).alias("_y"), (F.sum("_n").over(order) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    joined = rows.join(ahead, (F.col("_degree") == F.col("_d")) & F.col(year).eqNullSafe(F.col("_y")))
    within = F.row_number().over(Window.partitionBy("_degree", year).orderBy(key))
    cut = F.greatest(F.lit(1), F.floor(F.col("_all") / 5))
    return joined.withColumn("is_core", (F.col("_degree") > 0) & (F.col("_ahead") + within <= cut)).drop("_degree", "_d", "_y", "_ahead", "_all")


def centrality(nodes: DataFrame) -> DataFrame:
    """centrality (in + out) / 2N and novelty min(in / out, 1), or half of in without out."""
    total = max(1, 2 * nodes.count())
    novelty = F.when(F.col("citation_count") > 0, F.col("cited_by_count") / F.col("citation_count")).otherwise(F.col("cited_by_count") * 0.5)
    return nodes.withColumns({"centrality": (F.col("cited_by_count") + F.col("citation_count")) / F.lit(total), "novelty": F.least(novelty, F.lit(1.0))})


def peripheral(nodes: DataFrame, threshold: float = 0.1, k: int = 10, key: str = "id") -> DataFrame:
    return centrality(nodes).filter((F.col("centrality") < threshold) & (F.col("cited_by_count") > 0)).orderBy(F.desc("novelty"), key).limit(k)


def schools(nodes: DataFrame, edges: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """(founder, member) for the k most cited nodes that have two links or more; members are neighbours either way."""
    founders = nodes.orderBy(F.desc("cited_by_count"), F.desc("citation_count"), key).limit(k).filter("cited_by_count + citation_count >= 2").select(F.col(key).alias("founder"))
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.join(F.broadcast(founders), both["source"] == founders["founder"]).select("founder", F.col("target").alias("member")).distinct()


def evolution(nodes: DataFrame, year: str = "year", title: str = "title") -> DataFrame:
    """Per year: works, citations, the three most cited titles, core titles."""
    works = nodes.filter(F.col(year).isNotNull())
    best = F.row_number().over(Window.partitionBy(year).orderBy(F.desc("cited_by_count"), title))
    top = works.select(year, title, "cited_by_count").withColumn("_r", best).filter("_r <= 3")
    key_works = top.groupBy(year).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(title).alias("t")))), lambda x: x["t"]).alias("key_works"))
    core = F.array_sort(F.collect_list(F.when(F.col("is_core"), F.col(title))))
    totals = works.groupBy(year).agg(F.count("*").alias("works_count"), F.sum("citation_count").alias("total_citations"), core.alias("foundational_works"))
    return totals.join(key_works, year)


def citation_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: works, edges, edges per work, works without any edge, and the mean confidence of the edges."""
    alone = F.count_if((F.col("citation_count") == 0) & (F.col("cited_by_count") == 0))
    works = nodes.agg(F.count("*").alias("works"), alone.alias("isolated"))
    links = edges.agg(F.count("*").alias("edges"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    return works.join(links).withColumn("edges_per_work", F.col("edges") / F.greatest(F.col("works"), F.lit(1)))


def marked_nodes(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(kind, id): core works as `key`, works without any edge as `orphan`."""
    alone = (F.col("citation_count") == 0) & (F.col("cited_by_count") == 0)
    kinds = F.array_compact(F.array(F.when(F.col("is_core"), "key"), F.when(alone, "orphan")))
    return nodes.select(F.explode(kinds).alias("kind"), F.col(key).alias("id"))


def backlinks(notes: DataFrame) -> DataFrame:
    """(title, linked_from) of notes (title, text) that link to one another by [[title]]; a note's own links don't count."""
    found = notes.select(F.col("title").alias("linked_from"), F.explode(wiki_links(F.col("text"))).alias("title")).filter("title <> linked_from")
    return found.distinct()


def citation_network(docs: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works (id, title, year, text) with degrees and core flags, their first `most` edges by source and target, and one row of statistics.

    The cut is the report's own; degrees, flags and statistics are those of all edges. A network of more than three works without any edge is `sparse`.
    """
    edges = citation_edges(docs)
    nodes = with_core(degrees(docs.select("id", "title", "year"), edges))
    told = citation_statistics(nodes, edges)
    return nodes, edges.orderBy("source", "target").limit(most), told.withColumn("sparse", (F.col("edges") == 0) & (F.col("works") > 3))
