"""Configured facets of claims: which rules a claim triggers, how much of them a text covers, what to search for; and the order of matches by such evidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .evidence import match_text, nfkc

#: Rules are configuration: so many at most.
MOST_RULES = 1_000
#: Roles that name who or where, groups of facets with a bonus of their own, and the facets that queries combine.
ANCHOR_ROLES = ("anchor", "actor", "country", "person", "place", "institution")
GROUPS = ((("us", "economy", "future_influence"), 1.5), (("us", "future_influence"), 0.75), (("us", "economy"), 0.75))
COMBINED = (("economy", "future_influence"), ("vitality", "future_influence"))
#: Words of a hint that count more: in the query, in the snippet, and how much.
HINT_WORDS = (("民ヲ安ズル", "民ヲ安ズル", 0.8), ("門戸開放", "門戶開放", 0.5))

FACETS = "array<struct<bucket string, role string, terms array<struct<term string, word string>>>>"


def _compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
    except re.error:
        return False
    return bool(pattern)


def _rules(rules: DataFrame) -> list[dict]:
    """Rules in order, their triggers and terms as match texts too; more than MOST_RULES are an error."""
    first = rules.select("ord", F.trim("bucket").alias("bucket"), F.coalesce(F.nullif("role", F.lit("")), F.lit("theme")).alias("role"), "patterns", "triggers", "terms").filter("bucket <> ''").orderBy("ord").limit(MOST_RULES + 1)
    rows = first.collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    words = rules.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("triggers", "terms")]))).alias("t")).distinct()
    known = {r["t"]: r["w"] for r in words.select("t", match_text(F.col("t")).alias("w")).collect()}
    return [r.asDict() | {"known": known} for r in rows]


def claim_facets(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Claims (id, claim) with `facets`: an array of (bucket, role, terms) of the rules that they trigger; without any it is empty.

    rules: (ord, bucket, role, patterns, triggers, terms). A rule is triggered by a pattern found in the claim, whatever its case, or a trigger that the claim
    holds as match text; a pattern that is none is skipped. A bucket's terms are those of all its triggered rules in order, each once; buckets stand in the
    order of their first triggered rule, and one without terms goes. The last rule of a bucket gives its role. Rules become expressions, so
    claims are read once and never shuffled.
    """
    listed = _rules(rules)
    roles = {r["bucket"]: r["role"] for r in listed}
    rows = claims.withColumn("_n", nfkc(F.coalesce("claim", F.lit("")))).withColumn("_m", match_text(F.col("claim")))
    struct = FACETS[6:-1]
    found = []
    for r in listed:
        terms = [t.strip() for t in r["terms"] or [] if t and t.strip()]
        tests = [F.col("_n").rlike(f"(?iu){p}") for p in r["patterns"] or [] if _compiles(p)]
        tests += [F.contains("_m", F.lit(r["known"][t])) for t in r["triggers"] or [] if t and r["known"][t]]
        if tests:
            words = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(r["known"].get(t, "")).alias("word")) for t in terms]).cast("array<struct<term string, word string>>")
            found.append(F.when(reduce(Column.__or__, tests), F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(roles[r["bucket"]]).alias("role"), words.alias("terms")).cast(struct)))
    hit = F.array_compact(F.array(*found)) if found else F.array().cast(FACETS)
    rows = rows.withColumn("_hit", hit)
    buckets = F.array_distinct(F.transform("_hit", lambda f: F.struct(f["bucket"].alias("bucket"), f["role"].alias("role"))))
    own = lambda b: F.array_distinct(F.flatten(F.transform(F.filter("_hit", lambda f: f["bucket"] == b["bucket"]), lambda f: f["terms"])))
    merged = F.transform(buckets, lambda b: F.struct(b["bucket"].alias("bucket"), b["role"].alias("role"), own(b).alias("terms")))
    return rows.withColumn("facets", F.filter(merged, lambda f: F.size(f["terms"]) > 0)).drop("_n", "_m", "_hit")


def facet_bonus(covered: Column) -> Column:
    """Bonus of covered facets (bucket, role): 0.9 for each up to 4, more for certain groups, else for anchors with themes; 5 at most."""
    held = F.transform(covered, lambda f: f["bucket"])
    has = lambda names: F.size(F.array_intersect(held, F.array(*map(F.lit, names)))) == len(names)
    anchors = F.size(F.filter(covered, lambda f: f["role"].isin(*ANCHOR_ROLES)))
    themes = F.size(covered) - anchors
    extra = F.when((anchors > 0) & (themes >= 2), 1.25).when((anchors > 0) & (themes >= 1), 0.65).when(F.size(covered) >= 2, 0.35).otherwise(0.0)
    for names, more in reversed(GROUPS):
        extra = F.when(has(names), more).otherwise(extra)
    return F.least(F.lit(5.0), F.least(F.lit(4.0), F.size(covered) * 0.9) + extra)


def facet_packets(faceted: DataFrame, contexts: DataFrame, most: int = 4) -> DataFrame:
    """Contexts (id, text) of claims that have facets, where one is covered, with hits (bucket, terms), covered, missing and bonus.

    faceted: (id, facets) of `claim_facets`, an id once. A facet is covered by a term that the text holds as match text; `most` of its terms are told.
    """
    rows = contexts.join(faceted.select("id", "facets").filter(F.size("facets") > 0), "id").withColumn("_m", match_text(F.col("text")))
    held = lambda f: F.filter(f["terms"], lambda t: (t["word"] != "") & F.contains(F.col("_m"), t["word"]))
    found = F.transform("facets", lambda f: F.struct(f["bucket"].alias("bucket"), f["role"].alias("role"), F.slice(F.transform(held(f), lambda t: t["term"]), 1, most).alias("terms")))
    rows = rows.withColumn("_f", F.filter(found, lambda f: F.size(f["terms"]) > 0)).filter(F.size("_f") > 0)
    names = lambda c: F.array_sort(F.transform(c, lambda f: f["bucket"]))
    hits = F.transform("_f", lambda f: F.struct(f["bucket"].alias("bucket"), f["terms"].alias("terms")))
    rows = rows.withColumns({"hits": hits, "covered": names("_f"), "missing": F.array_except(names("facets"), names("_f")), "bonus": facet_bonus(F.col("_f"))})
    return rows.drop("_m", "_f", "facets")


def date_anchors(dates: Column) -> Column:
    """The first two of the dates that are more than a year, else of those with an era, else of all."""
    years = F.filter(dates, lambda d: ~F.regexp_replace(d, r"[\s\p{P}]+", "").rlike(r"^(1[89]\d{2}|20\d{2})年?$"))
    eras = F.filter(dates, lambda d: d.rlike("明治|大正|昭和|平成|令和"))
    return F.slice(F.when(F.size(years) > 0, years).when(F.size(eras) > 0, eras).otherwise(dates), 1, 2)


def facet_queries(facets: Column, dates: Column, most: int = 18) -> Column:
    """Searches for a claim with these facets and anchors of dates, the most particular first, each once.

    Date, anchor and theme; date and anchor where there are no themes; anchor and two combined facets; pairs of terms of all facets. Of a facet the first
    terms count, three in the first two forms, two in the others. Without facets there are none.
    """
    terms = lambda f, n: F.slice(F.transform(f["terms"], lambda t: t["term"]), 1, n)
    of = lambda fs, n: F.array_distinct(F.flatten(F.transform(fs, lambda f: terms(f, n))))
    anchor = lambda f: f["role"].isin(*ANCHOR_ROLES)
    bucket = lambda fs, name: F.flatten(F.transform(F.filter(fs, lambda f: f["bucket"] == name), lambda f: terms(f, 2)))
    buckets = sorted({name for pair in COMBINED for name in pair})

    # Each list of terms is computed once and then named, for lambdas would compute it again for each of their elements.
    lists = F.struct(F.flatten(F.transform(facets, lambda f: terms(f, 2))).alias("every"), of(F.filter(facets, anchor), 3).alias("named"), of(F.filter(facets, lambda f: ~anchor(f)), 3).alias("themed"), *[bucket(facets, b).alias(b) for b in buckets], dates.alias("dates"), F.size(facets).alias("facets"))

    def chosen(s: Column) -> Column:
        anchors = F.when(F.size(s["named"]) > 0, s["named"]).otherwise(F.array_distinct(s["every"]))
        themes = F.when(F.size(s["themed"]) > 0, s["themed"]).otherwise(F.array_except(s["every"], anchors))
        return bound(F.struct(anchors.alias("anchors"), themes.alias("themes")), lambda c: _listed(s, c["anchors"], c["themes"], most))

    return F.when(F.size(facets) > 0, bound(lists, chosen)).otherwise(F.array().cast("array<string>"))


def _listed(terms: Column, anchors: Column, themes: Column, most: int) -> Column:
    """The searches of lists of terms: every term, those of the combined facets, dates, the number of facets."""
    none, every, dates = F.array().cast("array<string>"), terms["every"], terms["dates"]

    def each(outer: Column, inner) -> Column:
        return F.flatten(F.transform(outer, inner))

    joined = lambda *parts: F.concat_ws(" ", *parts)
    full = each(F.slice(themes, 1, 6), lambda t: each(dates, lambda d: F.transform(F.slice(anchors, 1, 2), lambda a: joined(d, a, t))))
    plain = F.when(F.size(themes) == 0, each(dates, lambda d: F.transform(F.slice(anchors, 1, 4), lambda a: joined(d, a)))).otherwise(none)

    def combined(x: str, y: str, a: Column) -> Column:
        return each(terms[x], lambda s: F.transform(terms[y], lambda t: joined(a, s, t)))

    mixed = each(F.slice(anchors, 1, 3), lambda a: F.concat(*[combined(x, y, a) for x, y in COMBINED]))
    pairs = each(F.slice(every, 1, 4), lambda s: F.transform(F.filter(F.slice(every, 1, 6), lambda t: t != s), lambda t: joined(s, t)))
    listed = F.concat(full, plain, mixed, F.when(terms["facets"] >= 2, pairs).otherwise(none))
    clean = F.transform(listed, lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(clean, lambda q: q != "")), 1, most)


def reranked_matches(matches: DataFrame, candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """Matches with `weight` and their new `place` (from 1) among those of their candidate.

    matches: (id, ordinal, source_id, title, author, publisher, date, score, mismatch, source_rank); candidates: (id, year, publisher), an id once; hints: (id,
    source_id, query, snippet, pdf_page, specific). Mismatches come last, then weight to six places decides, then source_rank (none or 0: 9999), then ordinal. Equal
    years add 0.55 and others take 0.45; a publisher that the record names adds 0.45, one of three characters or more that it does not takes 0.2; the best
    specific hint of the source, or of none, adds 1.0 and more for words and a page. A match without a source_id takes the best hint of all. Hints are
    reduced to one value for each source before they are joined.
    """
    year = lambda c: F.regexp_extract(F.coalesce(F.col(c).cast("string"), F.lit("")), r"((?:18|19|20)\d{2})", 1)
    query, snippet = match_text(F.col("query")), match_text(F.col("snippet"))
    extra = F.lit(1.0)
    for asked, shown, more in HINT_WORDS:
        extra = extra + F.when(F.contains(query, F.lit(asked)) | F.contains(snippet, F.lit(shown)), more).otherwise(0.0)
    extra = extra + F.when(F.coalesce(F.col("pdf_page"), F.lit(0)) != 0, 0.1).otherwise(0.0)
    source = F.coalesce(F.col("source_id"), F.lit(""))
    told = hints.filter("specific").select("id", source.alias("_source"), extra.alias("_bonus"))
    own = told.groupBy("id", "_source").agg(F.max("_bonus").alias("_own"))
    overall = own.groupBy("id").agg(F.max(F.when(F.col("_source") == "", F.col("_own"))).alias("_any"), F.max("_own").alias("_all"))
    rows = matches.withColumn("_source", source).join(own.filter("_source <> ''"), ["id", "_source"], "left").join(overall, "id", "left")
    rows = rows.join(candidates.select("id", F.col("publisher").alias("_publisher"), year("year").alias("_year")), "id", "left")
    rows = rows.withColumns({"_p": match_text(F.col("_publisher")), "_r": match_text(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("publisher", "author", "title")]))})
    mine = F.coalesce("_year", F.lit(""))
    by_year = F.when((mine == "") | (year("date") == ""), 0.0).when(mine == year("date"), 0.55).otherwise(-0.45)
    by_publisher = F.when((F.col("_p") == "") | (F.col("_r") == ""), 0.0).when(F.contains("_r", F.col("_p")), 0.45).when(F.length("_p") >= 3, -0.2).otherwise(0.0)
    by_hint = F.coalesce(F.when(F.col("_source") == "", F.col("_all")).otherwise(F.greatest("_own", "_any")), F.lit(0.0))
    rows = rows.withColumn("weight", F.coalesce("score", F.lit(0.0)) + by_year + by_publisher + by_hint)
    rank = F.coalesce(F.nullif("source_rank", F.lit(0)), F.lit(9999))
    order = Window.partitionBy("id").orderBy(F.coalesce("mismatch", F.lit(False)), F.round("weight", 6).desc(), rank, "ordinal")
    return rows.withColumn("place", F.row_number().over(order)).select(*matches.columns, "weight", "place")
