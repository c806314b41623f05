"""Extraction: citations, quotes, headings, key-values, entities and their disambiguation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import collapse

from .dedup import keep_first
from .spread import spread

DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
YEAR = r"(?:^|[^0-9])((?:1[5-9]|20)\d\d)(?:$|[^0-9])"


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def citation_fields(citation: Column) -> Column:
    """title, year, volume, issue, pages, doi, url of a citation string; null where there is none."""
    return F.struct(
        _match(citation, '["“]([^"”]+?)[.,]?["”]').alias("title"),
        _match(citation, YEAR).alias("year"),
        _match(citation, r"(?i)vol\.?\s*(\d+)").alias("volume"),
        _match(citation, r"(?i)no\.?\s*(\d+)").alias("issue"),
        F.regexp_replace(_match(citation, r"(?i)pp?\.\s*(\d+(?:\s*[-–]\s*\d+)?)"), r"\s*[-–]\s*", "-").alias("pages"),
        F.regexp_replace(_match(citation, f"({DOI})"), r"[.,;]+$", "").alias("doi"),
        _match(citation, r"(https?://[^\s<>\"]+)").alias("url"),
    )


def citation_confidence(fields: Column) -> Column:
    """0.25, 0.18 for each of title, year and authors or container, 0.05 for each other field, at most 0.95."""
    core = sum((fields[c].isNotNull().cast("int") for c in ("title", "year", "volume")), F.lit(0))
    rest = sum((fields[c].isNotNull().cast("int") for c in ("issue", "pages", "doi", "url")), F.lit(0))
    return F.round(F.least(F.lit(0.95), 0.25 + core * 0.18 + rest * 0.05), 2)


def citation_style(citation: Column) -> Column:
    """The style with the most marks; the first one on ties."""
    votes = [
        ("chicago", citation.rlike('["“][^"”]+[.,]["”]').cast("int") + citation.rlike(r"(?i)vol\.\s*\d+,\s*no\.").cast("int")),
        ("apa", citation.rlike(r"\((1[5-9]|20)\d\d\)\.").cast("int") + citation.rlike(r"\d+\(\d+\)").cast("int")),
        ("gbt7714", citation.rlike(r"\[[JMDCNR]\]").cast("int") * 2),
    ]
    best = F.greatest(*[v for _, v in votes])
    out = F.lit("unknown")
    for name, vote in reversed(votes):
        out = F.when((vote == best) & (best > 0), name).otherwise(out)
    return out


def quotes(text: Column, least: int = 6) -> Column:
    """Quoted parts of four forms, at least `least` characters, each once in order of form."""
    forms = ("“([^”]+)”", "「([^」]+)」", "『([^』]+)』", '"([^"]+)"')
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f), 1) for f in forms]))
    return F.array_distinct(F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.length(q) >= least))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, level, title, content): Markdown sections; what is before the first heading is level 0."""
    heading = r"^(#{1,6})\s+(.+?)\s*#*$"
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    lines = lines.withColumn("is_heading", F.col("line").rlike(heading))
    lines = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy(key).orderBy("n")))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    first = F.min_by("line", "n")
    out = lines.groupBy(key, "section").agg(content.alias("content"), first.alias("head"))
    level = F.when(F.col("section") == 0, 0).otherwise(F.length(F.regexp_extract("head", heading, 1)))
    title = F.when(F.col("section") == 0, "Document Start").otherwise(F.regexp_extract("head", heading, 2))
    return out.select(key, "section", level.alias("level"), title.alias("title"), "content").filter(F.trim("content") != "")


def heading_parents(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """parent: the nearest earlier section with a smaller level; by one running value for each level, not by pairs."""
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("section")), ignorenulls=True).over(before) for k in range(7)]
    parent = F.lit(None).cast("long")
    for level in range(2, 7):
        parent = F.when(F.col("level") == level, F.array_max(F.array(*last[1:level]))).otherwise(parent)
    return sections.withColumn("parent", parent)


def key_values(text: Column) -> Column:
    """(key, value) of lines of the form key: value."""
    pattern = r"(?m)^[ \t]*([^:：\n]{1,40}?)[ \t]*[:：][ \t]*([^\n]+?)[ \t]*$"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("key"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("value"))


#: Dictionary entries that a task holds at once; a longer dictionary is taken in blocks.
DICTIONARY_BLOCK = 50_000


def dictionary_entities(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, category, start): every place of every dictionary entity, overlapping ones too, once for each of its categories.

    One pass over each text with an Aho-Corasick automaton of a block of `dictionary` (entity, category).
    """

    def scan(words: list[tuple[str, str]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            known = ahocorasick.Automaton()
            for entity, category in words:
                known.add_word(entity, (entity, [*known.get(entity, (entity, []))[1], category]))
            known.make_automaton()
            for batch in batches:
                out = [(k, entity, category, end - len(entity) + 1) for k, t in zip(batch[key], batch[text]) if t for end, (entity, kinds) in known.iter(t) for category in kinds]
                yield pd.DataFrame(out, columns=[key, "entity", "category", "start"])

        return run

    rows, found, held = docs.select(key, text), None, []
    schema = f"{key} {dict(docs.dtypes)[key]}, entity string, category string, start long"

    def with_block(found: DataFrame | None, held: list) -> DataFrame:
        hits = rows.mapInPandas(scan(held), schema)
        return hits if found is None else found.unionByName(hits)

    for row in dictionary.filter("entity <> ''").select("entity", "category").distinct().orderBy("entity", "category").toLocalIterator():
        held.append((row["entity"], row["category"]))
        if len(held) == DICTIONARY_BLOCK:
            found, held = with_block(found, held), []
    if held:
        found = with_block(found, held)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def disambiguated(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Each (entity, context) with the rule of its surface form that scores best, the first on ties.

    `rules`: entity, rule_order, standard_name, category, patterns, keywords. 0.35 for each pattern and 0.1 for each keyword in the
    context, at most 1. An unknown form keeps itself, with score 0.
    """
    hits = lambda words: F.coalesce(F.size(F.filter(words, lambda w: F.contains(F.col("context"), w))), F.lit(0))
    rows = entities.join(rules.withColumnRenamed("category", "rule_category"), "entity", "left")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0), hits(F.col("patterns"))) * 0.35 + F.greatest(F.lit(0), hits(F.col("keywords"))) * 0.1)
    best = keep_first(rows.withColumn("score", score), ["entity", "context"], [F.desc("score"), F.col("rule_order").asc_nulls_last()])
    known = F.col("rule_order").isNotNull()
    return best.select("entity", "context", F.when(known, F.col("standard_name")).otherwise(F.col("entity")).alias("standard_name"), "rule_category", F.round("score", 4).alias("score"), known.alias("known"))


def co_occurrences(sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, sentence, left, right): consecutive entities, in entity order, that one sentence holds."""
    held = sentences.join(entities, "doc_id").filter(F.contains("text", "entity"))
    following = F.lead("entity").over(Window.partitionBy("doc_id", "sentence").orderBy("ord"))
    return held.withColumn("right", following).filter("right IS NOT NULL").select("doc_id", "sentence", F.col("entity").alias("left"), "right")


def placed_matches(text: Column, pattern: str) -> Column:
    """(text, start) of every match of a pattern, one after another; each is looked for behind the last one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(s: Column, found: Column) -> Column:
        at = F.call_function("locate", found, text, s["at"] + 1)
        item = F.struct(found.alias("text"), (at - 1).alias("start"))
        return F.struct((at - 1 + F.length(found)).alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), start, step, lambda s: s["out"])


#: Forms of names, places and dates, and how sure they are.
RULES = (
    ("person", "[一-鿿]{2,4}(?:天皇|将军|公|侯|氏|子)?", 0.4),
    ("location", "[一-鿿]{2,6}(?:国|都|道|府|县|縣|市|村|町)", 0.45),
    ("date", r"\d{3,4}年(?:\d{1,2}月(?:\d{1,2}日)?)?", 0.7),
    ("date", r"(?:明治|大正|昭和|平成|令和)\d{1,2}年", 0.7),
)


def rule_entities(docs: DataFrame, key: str, text: str, categories: tuple[str, ...] = ("person", "location", "date")) -> DataFrame:
    """(key, entity, category, start, confidence) by RULES, each place of a category once; the surer rule stays."""

    def found_by(category: str, pattern: str, sure: float) -> Column:
        return F.transform(placed_matches(F.col(text), pattern), lambda m: F.struct(m["text"].alias("entity"), F.lit(category).alias("category"), m["start"].alias("start"), F.lit(sure).alias("confidence")))

    found = [found_by(*rule) for rule in RULES if rule[0] in categories]
    # Dealt by key first, so that no task groups the entities of a whole file.
    rows = spread(docs.select(key, text), key).select(key, F.explode(F.concat(*found)).alias("_e")).select(key, "_e.*")
    return rows.groupBy(key, "entity", "category", "start").agg(F.max("confidence").alias("confidence"))


def first_fields(text: Column, patterns: dict[str, list[str]]) -> Column:
    """A struct of fields: the first group of the first pattern that finds something, cleaned; empty where none does."""
    return F.struct(*[F.coalesce(*[F.nullif(collapse(F.regexp_extract(text, f"(?im){p}", 1)), F.lit("")) for p in some], F.lit("")).alias(name) for name, some in patterns.items()])


@F.pandas_udf(IntegerType())
def evidence_count(replies: pd.Series) -> pd.Series:
    """How many evidence_text fields of a JSON text, at any depth, say something; what is inside strings does not count, a text that is no JSON has none."""

    def count(text: str | None) -> int:
        try:
            held, n = [json.loads(text or "null")], 0
        except ValueError:
            return 0
        while held:
            value = held.pop()
            if isinstance(value, dict):
                n += bool(value.get("evidence_text"))
                held.extend(value.values())
            elif isinstance(value, list):
                held.extend(value)
        return n

    return replies.map(count).astype("int32")


def draft_quality(text: Column, sections: Column, wanted: int) -> Column:
    """(citation_markers, flags, confidence) of a draft of `sections` sections, of which `wanted` were asked for."""
    text = F.coalesce(text, F.lit(""))
    markers = F.regexp_count(text, F.lit(r"\[[0-9,\-]+\]|\([A-Z][A-Za-z]+,\s*\d{4}\)"))
    short, weak, bare = F.length(text) < 2000, sections < max(2, min(wanted, 3)), markers == 0
    flags = F.array_compact(F.array(F.when(short, "draft_short"), F.when(weak, "section_structure_weak"), F.when(bare, "no_citation_markers")))
    value = F.lit(0.45) + F.when(short, 0.0).otherwise(0.20) + F.when(sections >= 3, 0.20).otherwise(0.0) + F.when(bare, 0.0).otherwise(0.10) + F.when(short | weak | bare, 0.0).otherwise(0.05)
    return F.struct(markers.alias("citation_markers"), flags.alias("flags"), F.round(F.least(value, F.lit(0.98)), 2).alias("confidence"))
