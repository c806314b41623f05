"""Entities: normal form, filters, grouping, disambiguation and the notes made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no entity.
COMMON_WORDS = ["的", "是", "在", "有", "和", "与", "或", "但", "而", "也", "这", "那", "他", "她", "它", "我", "你", "们", "了", "の", "に", "は", "を", "が", "で", "と", "し", "て", "た"]


def normalized(entities: DataFrame, script: bool = True) -> DataFrame:
    """Rows (entity, text, name, position, start_pos, end_pos, confidence, category) with one name, a span and a confidence.

    The name is the first of the three that is not empty; the span follows from `position` and the name where it is missing.
    """
    name = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("entity", "text", "name")], F.lit(""))
    start = F.coalesce("start_pos", "position")
    end = F.coalesce(F.col("end_pos"), F.when(F.length(name) > 0, start + F.length(name)))
    confidence = F.coalesce("confidence", F.lit(0.45 if script else 0.75)).cast("double")
    return entities.withColumns({"entity": name, "start_pos": start, "end_pos": end, "confidence": confidence, "category": F.coalesce("category", F.lit("unknown"))}).drop("text", "name", "position")


def kept_entities(entities: DataFrame, text: str, key: list[str]) -> DataFrame:
    """Entities (key, entity, category, start_pos, end_pos, confidence) without blank, short (dates may be) and common ones.

    Of equal (entity, start_pos, category) the most confident, longest one stays. Where the span lies inside the text, the
    entity is what the text has there.
    """
    name = F.col("entity")
    sound = (F.length(F.trim(name)) > 0) & ((F.length(name) >= 2) | (F.col("category") == "date")) & ~name.isin(COMMON_WORDS)
    order = Window.partitionBy(*key, "entity", "start_pos", "category").orderBy(F.desc("confidence"), F.desc(F.length("entity")), "end_pos")
    rows = entities.filter(sound).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    inside = (F.col("start_pos") < F.length(text)) & (F.col("end_pos") <= F.length(text))
    return rows.withColumn("entity", F.when(inside, F.substring(F.col(text), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))).otherwise(name))


def by_category(entities: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, category, names): the entities of each category in order; no category is `unknown`."""
    category = F.coalesce("category", F.lit("unknown")).alias("category")
    names = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("entity").alias("_name")))), lambda s: s["_name"])
    return entities.groupBy(*key, category).agg(names.alias("names"))


def category_summary(entities: DataFrame, order: str, samples: int = 3) -> DataFrame:
    """(category, n, samples): how many entities, and the first `samples` of them in `order`."""
    first = Window.partitionBy("category").orderBy(order)
    some = entities.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples)
    names = some.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "entity"))), lambda s: s["entity"]).alias("samples"))
    return entities.groupBy("category").agg(F.count("*").alias("n")).join(names, "category")


def disambiguated_entities(entities: DataFrame, results: DataFrame) -> DataFrame:
    """Entities (entity, category, confidence) with type, confidence and standard name of their result; those without one stay as they are.

    Of several results (original_entity, ordinal, type, confidence, standard_name) for a name the last one counts.
    """
    last = results.groupBy("original_entity").agg(F.max_by(F.struct("type", F.col("confidence").alias("c"), "standard_name"), "ordinal").alias("_d"))
    joined = entities.join(last, entities["entity"] == last["original_entity"], "left").drop("original_entity")
    name = F.when(F.length("_d.standard_name") > 0, F.col("_d.standard_name"))
    return joined.withColumns({"category": F.coalesce("_d.type", "category"), "confidence": F.coalesce("_d.c", "confidence"), "standard_name": name}).drop("_d")


def disambiguation_summary(results: DataFrame, low: float = 0.6) -> DataFrame:
    """One row: counts of results (entity, standard_name, type, confidence), of standard names that differ, unknown and unsure ones, and the mean."""
    differs = (F.length("standard_name") > 0) & (F.col("standard_name") != F.col("entity"))
    mean = F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0))
    return results.agg(F.count("*").alias("resolved_count"), F.count_if(differs).alias("standard_name_count"), F.count_if(F.col("type") == "unknown").alias("unknown_count"), F.count_if(F.col("confidence") < low).alias("low_confidence_count"), mean.alias("average_confidence"))


def batch_summary(entities: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """One row: documents and entities of a batch, the mean confidence and the flags it gets."""
    of = entities.agg(F.count("*").alias("entity_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("_review"))
    out = documents.agg(F.count_distinct(key).alias("documents_processed")).join(of)
    flags = F.filter(F.array(F.when(F.col("documents_processed") == 0, "no_documents"), F.when(F.col("_review"), "document_review_needed")), lambda f: f.isNotNull())
    return out.withColumn("quality_flags", flags).drop("_review")


def name_evaluation(texts: DataFrame, names: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """(key, char_count, expected, found, missing, marker_hits) of recognised texts against the names (key, name) they should hold. White space is ignored."""
    compact = F.regexp_replace(text, r"\s+", "")
    rows = texts.select(key, compact.alias("_t"), F.length(compact).alias("char_count"), sum((F.length(compact) - F.length(F.replace(compact, F.lit(m), F.lit("")))) / len(m) for m in markers).cast("long").alias("marker_hits"))
    found = F.contains("_t", F.col("name"))
    counted = rows.join(names.select(key, "name"), key).groupBy(key).agg(F.count("*").alias("expected"), F.count_if(found).alias("found"))
    joined = rows.drop("_t").join(counted, key, "left")
    zero = F.lit(0).cast("long")
    return joined.select(key, "char_count", F.coalesce("expected", zero).alias("expected"), F.coalesce("found", zero).alias("found"), F.coalesce(F.col("expected") - F.col("found"), zero).alias("missing"), "marker_hits")


def linked_text(text: Column, names: list[str]) -> Column:
    """Every name in [[...]], longer ones first; a name that is linked already stays."""
    for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        quoted = "\\Q" + name + "\\E"
        text = F.when(F.contains(text, F.lit(f"[[{name}]]")), text).otherwise(F.regexp_replace(text, rf"(?<!\[\[){quoted}(?!\]\])", f"[[{name}]]"))
    return text


def entity_notes(entities: DataFrame, order: list[str]) -> DataFrame:
    """(category, markdown): a heading and an item for each entity (entity, notes, confidence, source) of a category."""
    detail = F.concat_ws("\n", F.concat(F.lit("- **"), "entity", F.lit("**")), F.when(F.length("notes") > 0, F.concat(F.lit("  - 说明："), "notes")), F.when(F.col("confidence") > 0, F.format_string("  - 置信度：%.2f", "confidence")), F.when(F.length("source") > 0, F.concat(F.lit("  - 来源："), "source")))
    items = entities.select("category", F.struct(*order, detail.alias("_item")).alias("_s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_item"]), "\n")
    return items.groupBy("category").agg(F.concat(F.lit("## "), F.first("category"), F.lit("\n\n"), body).alias("markdown"))
