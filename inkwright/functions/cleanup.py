"""Cleanups of recognised text, search keys and term lists, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, collapse

_KANA_HANGUL = "぀-ゟ゠-ヿ가-힯"
#: Replacements after recognition, in this order.
LIGHT_FIXES = [(" ,", ","), (" .", "."), (" , ", ", "), (" . ", ". "), ("  ", " "), ("— ", "—"), ("「 ", "「"), (" 」", "」")]
#: Character variants of the source key and of the lookup title.
SOURCE_VARIANTS = ("國會學條關說卷册·", "国会学条関説巻冊・")
LOOKUP_VARIANTS = ("關說會舊國圖學", "関説会旧国図学")
#: Character variants and marks of match texts.
MATCH_VARIANTS = ("人戰國會體訓號竜實踐聽營廳驒覺證擔豫終爐兒聲變關縣處祿學與", "亻戦国会体训号龍実践聴営庁駄覚証担予终炉児声変関県処禄学与")
MATCH_MARKS = "「」『』《》“”\"'`・･、，。．：:；;（）()！？【】[]-—" + "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f　"
_SOURCE_MARKS = r"[\s　「」『』《》〈〉（）()\[\]［］・･·,，.。:：;；、\-‐‑–—_/]+"
_LOOKUP_MARKS = r"[\s　『』「」《》〈〉（）()［］\[\]・,，.。:：;；、\-ー―—_/]+"
_ALIAS_MARKS = r"[\s　「」『』《》〈〉（）()［］\[\]、，,。．.・·:：；;]+"


def cleaned_text(text: Column, whitespace: bool = True, unicode: bool = True, special: bool = False) -> Column:
    """Runs of white space become one space (line ends too), ideographic spaces plain ones; special marks go on request."""
    if whitespace:
        text = F.regexp_replace(text, r"[\s　]+", " ")
    if unicode:
        text = F.replace(text, F.lit("　"), F.lit(" "))
    if special:
        text = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_\s{HAN}{_KANA_HANGUL}]", "")
    return F.trim(text)


def lightly_corrected(text: Column) -> Column:
    """Spaces that recognition puts around marks go, by LIGHT_FIXES in order."""
    return F.trim(reduce(lambda t, fix: F.replace(t, F.lit(fix[0]), F.lit(fix[1])), LIGHT_FIXES, text))


def without_watermarks(text: Column, patterns: list[str]) -> Column:
    """The given marks, scan numbers (E and 8 digits or more) and time stamps go; no more than one blank line stays."""
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    text = F.regexp_replace(text, r"E\d{8,}", "")
    text = F.regexp_replace(text, r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def without_tags(text: Column) -> Column:
    """Text of recognised HTML: fences go, paragraphs and breaks become line ends, other tags go."""
    text = F.regexp_replace(text, r"```(html)?\s*", "")
    text = F.regexp_replace(text, r"(?i)<p[^>]*>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def source_key(text: Column) -> Column:
    """Lower case, one form of variant characters, no marks or spaces. Width forms are left to `evidence.nfkc`."""
    return F.regexp_replace(F.translate(F.lower(text), *SOURCE_VARIANTS), _SOURCE_MARKS, "")


def lookup_title(text: Column) -> Column:
    return F.regexp_replace(F.translate(collapse(text), *LOOKUP_VARIANTS), _LOOKUP_MARKS, "")


def alias_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _ALIAS_MARKS, "")


def style_tokens(text: Column) -> Column:
    """Latin words of two letters or more (hyphens and apostrophes inside) and runs of two Han characters or more."""
    return F.regexp_extract_all(text, F.lit(rf"([A-Za-z][A-Za-z\-']+|[{HAN}]{{2,}})"), 1)


def author_terms(author: Column) -> Column:
    """The first two authors of a list."""
    return F.slice(F.filter(F.transform(F.split(author, "[、,，;；]"), collapse), lambda a: F.length(a) > 0), 1, 2)


def title_terms(title: Column) -> Column:
    """Six search terms of a title at most: its parts at colons and dashes, each followed by its own parts, then longer words; each once."""

    def chunks(part: Column) -> Column:
        return F.concat(F.array(part), F.filter(F.transform(F.split(part, "[のと・／/]"), collapse), lambda c: F.length(c) > 0))

    parts = F.filter(F.transform(F.split(title, "[：:\\-—]"), collapse), lambda p: F.length(p) > 0)
    words = F.regexp_extract_all(title, F.lit("([぀-ヿ㐀-鿿A-Za-z0-9]{2,})"), 1)
    return F.slice(F.array_distinct(F.concat(F.flatten(F.transform(parts, chunks)), words)), 1, 6)


#: Modern and historical forms of characters.
MODERN, HISTORICAL = "国条体学会", "國條體學會"


def title_variants(title: Column) -> Column:
    """Ten forms of a title at most: itself, with marks as spaces, without marks, its parts, and these in historical and modern characters; each once."""
    cleaned = collapse(title)
    forms = F.concat(F.array(cleaned, collapse(F.regexp_replace(cleaned, "[・·／/、，,;；]+", " ")), F.regexp_replace(cleaned, "[\\s　・·／/、，,;；]+", "")), F.transform(F.split(cleaned, "[・·／/、，,;；]+"), collapse))
    forms = F.array_distinct(F.filter(forms, lambda v: F.length(v) > 0))
    spelled = F.flatten(F.transform(forms, lambda v: F.array(F.translate(v, MODERN, HISTORICAL), F.translate(v, HISTORICAL, MODERN))))
    return F.slice(F.array_distinct(F.concat(forms, spelled)), 1, 10)


def outline(text: Column) -> Column:
    """(level, title, position) of ATX headings; the position is that of the heading's first character."""
    pattern = r"(?m)^(#{1,6})[ \t]+(.+)$"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<level:int,title:string,position:int>>").alias("out"))

    def step(s: Column, heading: Column) -> Column:
        at = F.call_function("locate", F.concat(F.lit("\n"), heading), F.concat(F.lit("\n"), text), s["at"] + 1)
        item = F.struct(F.length(F.regexp_extract(heading, pattern, 1)).alias("level"), F.trim(F.regexp_extract(heading, pattern, 2)).alias("title"), (at - 1).alias("position"))
        return F.struct((at - 1 + F.length(heading)).alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    return F.aggregate(found, start, step, lambda s: s["out"])
