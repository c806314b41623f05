"""Text functions as Column expressions: cleanup, tokens, sentences, windows, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "一-鿿"
KANA = "぀-ヿ"


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s 　]+", " "))


def tokens(text: Column) -> Column:
    """Maximal runs of Han characters, of a-z, or of 0-9, of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{HAN}]+|[a-z]+|[0-9]+)"), 1)


def sentences(text: Column) -> Column:
    """Sentences with their end mark (。！？.!? or a line end), trimmed, blank ones dropped."""
    found = F.regexp_extract_all(text, F.lit(r"([^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+)"), 1)
    # Ends are looked at, not every character of a sentence: a pattern with $ would be tried at each run of white space.
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: F.length(s) > 0)


def paragraphs(text: Column, least: int = 0) -> Column:
    """(index, text) of blank-line separated paragraphs, lines joined by a space; short ones go, indexes stay."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    parts = F.filter(parts, lambda p: F.length(p) > 0)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("index"), p.alias("text")))
    return F.filter(numbered, lambda p: F.length(p["text"]) >= least)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """(index, start, text) windows of `size` characters, each `size - overlap` after the last; blank ones go."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("index"), s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.filter(cut, lambda w: F.length(F.trim(F.regexp_replace(w["text"], r"\s+", " "))) > 0)


def token_estimate(text: Column) -> Column:
    """Han characters plus a quarter of all others."""
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    return han + F.floor((F.length(text) - han) / 4).cast("int")


def split_language(text: Column) -> Column:
    """Which separators a splitter should use: japanese, chinese or general."""
    han = F.regexp_count(text, F.lit(f"[{HAN}]"))
    kana = F.regexp_count(text, F.lit(f"[{KANA}]"))
    return F.when(kana > han * 0.1, "japanese").when(han > F.length(text) * 0.3, "chinese").otherwise("general")


def reading_language(text: Column) -> Column:
    """Language by shares of all characters: chinese, japanese, mixed_cjk, other; unknown without any."""
    size = F.length(text)
    han, kana = F.regexp_count(text, F.lit("[一-鿿]")) / size, F.regexp_count(text, F.lit("[぀-ヿ]")) / size
    return F.when(size == 0, "unknown").when(han > 0.3, "chinese").when(kana > 0.2, "japanese").when((kana > 0.1) & (han > 0.1), "mixed_cjk").otherwise("other")


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, the common entities are resolved, white space collapses."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return collapse(text)


def links(text: Column) -> Column:
    """(title, url) of Markdown links; image links match too."""
    pattern = r"\[([^\]]*)\]\(([^)]+)\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("title"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("url"))


def code_blocks(text: Column) -> Column:
    """(index, language, line_count, preview) of fenced code blocks."""
    fence = r"(?s)```(\w*)\n.*?```"
    blocks = F.regexp_extract_all(text, F.lit(fence), 0)

    def facts(block: Column, i: Column) -> Column:
        lines = F.split(block, "\n")
        return F.struct(i.alias("index"), F.regexp_extract(block, fence, 1).alias("language"), (F.size(lines) - 2).alias("line_count"), F.substring(F.array_join(F.slice(lines, 2, 3), "\n"), 1, 100).alias("preview"))

    return F.transform(blocks, facts)


def truncated(text: Column, limit: int = 700) -> Column:
    cleaned = collapse(text)
    return F.when(F.length(cleaned) <= limit, cleaned).otherwise(F.concat(F.rtrim(F.substring(cleaned, 1, limit)), F.lit("...")))


def snippet(text: Column, query: Column, radius: int = 90) -> Column:
    """The first place of the query with `radius` characters around it; null where it doesn't occur."""
    at = F.instr(text, query)
    return F.when(at > 0, F.substring(text, F.greatest(at - radius, F.lit(1)), F.length(query) + radius + F.least(at - 1, F.lit(radius))))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def document_id(source: Column, content: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", source, F.substring(content, 1, 100))), 1, 16)


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", document, index.cast("string"), F.substring(content, 1, 50))), 1, 16)


def safe_file_name(name: Column, limit: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_")), 1, limit)


def file_type(path: Column) -> Column:
    """pdf, markdown, text, html, docx or unknown, by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("md", "markdown"), "markdown").when(suffix == "txt", "text").when(suffix.isin("html", "htm"), "html").when(suffix == "docx", "docx").otherwise("unknown")


def wiki_links(text: Column) -> Column:
    """Titles in [[...]], without an alias after |."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda t: F.trim(F.split(t, r"\|")[0])))
