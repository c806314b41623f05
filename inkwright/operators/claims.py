"""Claims, review sentences and their alignment with pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, collapse

_SENTENCE_END, _CLAUSE_END = "。！？；;.!?", "，,、；;：:"
#: The space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _pieces(text: Column, marks: str) -> Column:
    """Parts of a cleaned text that end after one of the marks, without spaces at their ends, blank ones dropped."""
    found = F.regexp_extract_all(text, F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+)"), 1)
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def _grouped(parts: Column, joins) -> Column:
    """Neighbouring parts in one group as long as joins(group, part) says so."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, part: Column) -> Column:
        more = F.struct(s["done"].alias("done"), F.concat(s["held"], part).alias("held"))
        fresh = F.struct(F.concat(s["done"], F.array(s["held"])).alias("done"), part.alias("held"))
        first = F.struct(s["done"].alias("done"), part.alias("held"))
        return F.when(s["held"].isNull(), first).when(joins(s["held"], part), more).otherwise(fresh)

    return F.aggregate(parts, start, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def claims(text: Column, longest: int = 160, clause_group: int = 150, least: int = 4) -> Column:
    """Sentences; one of more than `longest` characters becomes groups of clauses of at most `clause_group`. Each once."""

    def split(sentence: Column) -> Column:
        clauses = _grouped(_pieces(sentence, _CLAUSE_END), lambda held, part: F.length(held) + F.length(part) <= clause_group)
        return F.when(F.length(sentence) <= longest, F.array(sentence)).otherwise(clauses)

    found = F.flatten(F.transform(_pieces(collapse(text), _SENTENCE_END), split))
    return F.array_distinct(F.filter(found, lambda c: F.length(c) >= least))


def page_claims(text: Column, most: int = 8) -> Column:
    """Clauses, joined while the group has less than 18 characters or the next one less than 8; at most `most`, each once."""

    def listed(cleaned: Column) -> Column:
        parts = _grouped(_pieces(cleaned, "。！？!?；;，、,"), lambda held, part: (F.length(held) < 18) | (F.length(part) < 8))
        found = F.slice(F.array_distinct(F.filter(parts, lambda c: F.length(c) >= 6)), 1, most)
        some = bound(found, lambda f: F.when(F.size(f) == 0, F.array(cleaned)).otherwise(f))
        return F.when(F.length(cleaned) == 0, F.array().cast("array<string>")).otherwise(some)

    return bound(collapse(text), listed)


def review_sentences(text: Column, most: int = 12, least: int = 4) -> Column:
    """First `most` different sentences of at least `least` characters; a line end parts sentences, too."""
    marks = "。．.!！?？"
    spaced = F.regexp_replace(F.translate(text, "\r", "\n"), r"[\s\x{a0}\x{3000}&&[^\n]]+", " ")
    lines = F.regexp_extract_all(spaced, F.lit(f"([^\n{marks}]*[{marks}]|[^\n{marks}]+)"), 1)
    found = F.slice(F.array_distinct(F.filter(F.transform(lines, lambda p: F.trim(p)), lambda s: F.length(s) >= least)), 1, most)
    whole = F.substring(collapse(text), 1, 260)
    rest = F.when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))


def window_text(text: Column) -> Column:
    """The cleaned text, also without the wider spaces of Unicode at its ends."""
    return F.btrim(collapse(text), F.lit(SPACES))


def best_window(text: Column, score, size: int = 220, step: int = 60, whole: int = 260) -> Column:
    """The whole text if it has at most `whole` characters, else its window with the best score; the first one wins ties, and it must beat the text itself."""
    return bound(window_text(text), lambda t: best_part(t, score, size, step, whole))


def best_part(cleaned: Column, score, size: int = 220, step: int = 60, whole: int = 260) -> Column:
    """best_window of a window_text."""
    piece = rf"(?s).{{1,{step}}}"

    def scored(part: Column, at: Column) -> Column:
        return bound(part, lambda w: F.struct(score(w).cast("double").alias("score"), (-at).alias("at"), w.alias("text")))

    def windows(t: Column, pieces: Column) -> Column:
        # Windows are put together from pieces of a step's length, so that the text is read once, not from its beginning for each.
        last = F.floor(F.greatest(F.length(t) - size, F.lit(0)) / step).cast("int")
        held = lambda k: F.left(F.array_join(F.slice(pieces, k + 1, -(-size // step)), ""), F.lit(size))
        return F.array_max(F.transform(F.sequence(F.lit(0), last), lambda k: scored(held(k), k)))

    def best(t: Column) -> Column:
        found = bound(F.regexp_extract_all(t, F.lit(piece), 0), lambda pieces: windows(t, pieces))
        return bound(found, lambda b: F.when(b["score"] > score(t).cast("double"), b["text"]).otherwise(t))

    return F.when(F.length(cleaned) <= whole, cleaned).otherwise(best(cleaned))


def claim_summary(alignments: DataFrame, candidate: str) -> DataFrame:
    """Per candidate of (candidate, claim_index, matched_page, confidence, matched_text): aligned and total claims, the mean, the best page.

    A claim without a matched text counts in the total alone. Of equal confidences the first claim's page is the best.
    """
    aligned = F.col("matched_text") != ""
    best = F.max_by(F.struct("matched_page", "confidence"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("claim_index")))
    out = alignments.groupBy(candidate).agg(F.count_if(aligned).alias("aligned_claims"), F.count("*").alias("total_claims"), F.round(F.avg(F.when(aligned, F.coalesce("confidence", F.lit(0.0)))), 4).alias("average_confidence"), best.alias("b"))
    return out.filter("aligned_claims > 0").select(candidate, "aligned_claims", "total_claims", "average_confidence", F.col("b.matched_page").alias("best_page"), F.col("b.confidence").alias("best_confidence"))


def cited_pages(pages: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with `is_cited`: whether `cited` names them. Rows that cannot be compared (null) are context."""
    named = cited.select(*keys).distinct().withColumn("is_cited", F.lit(True))
    return pages.join(named, keys, "left").withColumn("is_cited", F.coalesce("is_cited", F.lit(False)))


def citation_candidates(paragraphs: DataFrame, footnotes: DataFrame) -> DataFrame:
    """(candidate_id, paragraph, footnote_id, text): each footnote id of a paragraph that is known and verifiable, if there is a text.

    paragraphs: (paragraph, text, footnote_ids); footnotes: (footnote_id, verifiable).
    """
    named = paragraphs.select("paragraph", "text", F.explode("footnote_ids").alias("footnote_id"))
    known = footnotes.filter("verifiable").select("footnote_id").distinct()
    found = named.join(known, "footnote_id").filter(F.length(F.trim("text")) > 0)
    return found.select(F.format_string("p%d-f%s", "paragraph", F.col("footnote_id").cast("string")).alias("candidate_id"), "paragraph", "footnote_id", "text")


def merged_overlap(left: Column, right: Column, least: int = 8) -> Column:
    """Two texts as one where one holds the other or the end of one is the beginning of the other (`least` characters or more); else the first."""
    a, b = collapse(left), collapse(right)
    sizes = F.sequence(F.greatest(F.least(F.length(a), F.length(b)), F.lit(least)), F.lit(least), F.lit(-1))

    def joined(size: Column) -> Column:
        forward = F.endswith(a, F.substring(b, F.lit(1), size))
        backward = F.endswith(b, F.substring(a, F.lit(1), size))
        return F.when(forward, F.concat(a, F.substring(b, size + 1, F.length(b)))).when(backward, F.concat(b, F.substring(a, size + 1, F.length(a))))

    tried = F.filter(F.transform(sizes, joined), lambda x: x.isNotNull())
    long_enough = F.least(F.length(a), F.length(b)) >= least
    overlap = F.when(long_enough, F.get(tried, F.lit(0)))
    return F.when(F.length(a) == 0, b).when(F.length(b) == 0, a).when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.coalesce(collapse(overlap), a))
