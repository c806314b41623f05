"""Citations: fields of one string, their check and confidence, rendering in six styles, mentions in text, footnotes."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

_YEAR = r"\b((?:19|20)\d{2}[a-z]?)\b"
_MARKS = " .,:;[]()"
_SKIPPED = r"(?i)^(vol|no|pp|doi|http)"
CORE = ("title", "authors", "year")
EXTRA = ("pages", "volume", "issue", "doi", "url", "container")


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(_MARKS))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _without(text: Column, part: Column) -> Column:
    """The text with the first place of `part` as a space."""
    at = F.instr(text, part)
    return F.when((F.length(part) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def citation_authors(text: Column) -> Column:
    """What comes before the year and the first quotation mark, parted at `and`, `&` and semicolons; six at most."""
    year = F.regexp_instr(text, F.lit(_YEAR))
    prefix = _bare(F.when(year > 0, F.substring(text, F.lit(1), year - 1)).otherwise(text))
    prefix = F.trim(F.split(prefix, '["“]', 2)[0])
    parts = F.filter(F.transform(F.split(prefix, r"\s+and\s+|,\s*&\s*|,\s+and\s+|;|，|、"), _bare), lambda a: F.length(a) > 0)
    return F.slice(parts, 1, 6)


def _parts(text: Column, pattern: str) -> Column:
    parts = F.filter(F.transform(F.split(text, pattern), _bare), lambda p: F.length(p) > 0)
    return F.filter(parts, lambda p: ~p.rlike(_SKIPPED) & ~p.rlike(r"^\d+(-\d+)?$"))


def citation_records(citations: DataFrame, text: str) -> DataFrame:
    """`record` for every citation: type, authors, year, title, pages, volume, issue, doi, url and container (journal or publisher).

    The title is the quoted part, else the first part of three characters or more that is no author, year, number or
    label. What is not found is empty. Steps are columns of their own, so that none is computed twice.
    """
    lower = F.lower("_t")
    kind = F.when(lower.rlike("press|publisher|出版社|書店"), "book").when(lower.rlike("thesis|dissertation|学位论文"), "thesis").when(lower.rlike("proceedings|conference"), "conference").when(lower.rlike(r"vol\.\s*\d+|no\.\s*\d+|journal"), "article").when(lower.rlike("http|doi"), "electronic").otherwise("article")
    cleaned = F.col("_t")
    steps = citations.withColumn("_t", collapse(F.col(text)))
    steps = steps.withColumns({"_year": _first(cleaned, _YEAR), "_authors": citation_authors(cleaned), "_doi": F.rtrim(_first(cleaned, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"), F.lit(".,;)")), "_url": F.rtrim(_first(cleaned, r"(?i)(https?://[^\s]+)"), F.lit(".,;)"))})
    steps = steps.withColumn("_joined", F.array_join("_authors", ", "))
    steps = steps.withColumn("_rest", F.when((F.size("_authors") > 0) & F.startswith("_t", F.col("_joined")), F.substring("_t", F.length("_joined") + 1, F.length("_t"))).otherwise(cleaned))
    steps = steps.withColumn("_rest", _without(F.col("_rest"), F.col("_year")))
    steps = steps.withColumn("_parts", F.filter(_parts(F.col("_rest"), r"\.\s+|,\s+"), lambda p: F.length(p) >= 3))
    quoted = F.btrim(_first(cleaned, r'["“](.+?)["”]'), F.lit(" ."))
    steps = steps.withColumn("_title", F.when(cleaned.rlike(r'["“].+?["”]'), quoted).otherwise(F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))))
    steps = steps.withColumn("_left", _without(cleaned, F.col("_title")))
    steps = steps.withColumn("_left", _without(F.col("_left"), F.col("_year")))
    for found in ("_doi", "_url"):
        steps = steps.withColumn("_left", F.when(F.length(found) > 0, F.replace("_left", F.col(found), F.lit(" "))).otherwise(F.col("_left")))
    steps = steps.withColumn("_parts", _parts(F.col("_left"), r"\.\s+|,\s+"))
    container = F.get(F.filter("_parts", lambda p: ~F.array_contains("_authors", p) & (p != F.col("_title")) & (p != F.col("_year"))), F.lit(0))
    issue = F.coalesce(F.nullif(_first(cleaned, r"(?i)no\.?\s*(\d+)"), F.lit("")), _first(cleaned, r"\b\d+\((\d+)\)"))
    pages = F.regexp_replace(_first(cleaned, r"(?i)(?:pp?\.?\s*)?(\d+\s*[-–]\s*\d+)"), r"\s+", "")
    fields = {"type": kind, "authors": F.col("_authors"), "year": F.col("_year"), "title": F.col("_title"), "pages": pages, "volume": _first(cleaned, r"(?i)vol\.?\s*(\d+)"), "issue": issue, "doi": F.col("_doi"), "url": F.col("_url"), "container": F.coalesce(container, F.lit(""))}
    steps = steps.withColumn("record", F.struct(*[c.alias(name) for name, c in fields.items()]))
    return steps.drop(*[c for c in steps.columns if c.startswith("_")])


def record_confidence(record: Column) -> Column:
    """0.25, and 0.18 for each of title, authors and year, 0.05 for each other field; 0.95 at most."""
    core = sum((F.when(F.size(record[c]) > 0 if c == "authors" else F.length(record[c]) > 0, 0.18).otherwise(0.0) for c in CORE), F.lit(0.25))
    return F.round(F.least(sum((F.when(F.length(record[c]) > 0, 0.05).otherwise(0.0) for c in EXTRA), core), F.lit(0.95)), 2)


def field_issues(record: Column) -> Column:
    """(missing, warnings) of a record: core fields that are empty; a year that is not four digits, a DOI that does not begin with 10."""

    def some(items: list[Column]) -> Column:
        return F.filter(F.array(*items), lambda i: i.isNotNull())

    missing = some([F.when(F.size(record[c]) == 0 if c == "authors" else F.length(record[c]) == 0, c) for c in CORE])
    warnings = some([F.when((F.length(record["year"]) > 0) & ~record["year"].rlike(r"^\d{4}$"), "year is not a plain 4-digit value"), F.when((F.length(record["doi"]) > 0) & ~F.startswith(record["doi"], F.lit("10.")), "doi does not look canonical")])
    return F.struct(missing.alias("missing"), warnings.alias("warnings"))


def rendered(record: Column, style: str, index: Column | None = None) -> Column:
    """An article's citation in chicago, apa, mla, gb7714, ieee or harvard; labels of empty fields go."""
    author = F.when(F.size(record["authors"]) > 0, F.array_join(record["authors"], ", ")).otherwise("Unknown")

    def or_else(name: str, other: str) -> Column:
        return F.when(F.length(record[name]) > 0, record[name]).otherwise(other)

    title, place, year = or_else("title", "Untitled"), or_else("container", "Unknown"), or_else("year", "n.d.")
    volume, issue, pages = record["volume"], record["issue"], record["pages"]
    number = F.lit(1) if index is None else index
    forms = {
        "chicago": ('%s. "%s." %s, %s, %s(%s): %s.', (author, title, place, year, volume, issue, pages), ((" ,", ","), ("()", ""))),
        "apa": ("%s (%s). %s. %s, %s(%s), %s.", (author, year, title, place, volume, issue, pages), ((" ,", ","), ("()", ""))),
        "mla": ('%s. "%s." %s, vol. %s, no. %s, %s, pp. %s.', (author, title, place, volume, issue, year, pages), (("vol. ,", ""), ("no. ,", ""))),
        "gb7714": ("[%s] %s. %s[J]. %s, %s, %s(%s): %s.", (number.cast("string"), author, title, place, year, volume, issue, pages), ((" ,", ","), ("()", ""))),
        "ieee": ('[%s] %s, "%s," %s, vol. %s, no. %s, pp. %s, %s.', (number.cast("string"), author, title, place, volume, issue, pages, year), (("vol. ,", ""), ("no. ,", ""))),
        "harvard": ("%s (%s) %s. %s, pp. %s.", (author, year, title, place, pages), ((", pp. .", "."),)),
    }
    form, values, gone = forms[style]
    text = F.format_string(form, *values)
    for old, new in gone:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def mentions(text: Column) -> Column:
    """Author-year mentions in parentheses and numbers in brackets, the former first, each once: (raw, year, page, title, confidence)."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\([A-Z][A-Za-z]+(?:\s+et al\.)?,?\s*\d{4}\)"), 0), F.regexp_extract_all(text, F.lit(r"\[\d+\]"), 0))

    def parsed(raw: Column) -> Column:
        year = F.nullif(_first(raw, r"((?:19|20)\d{2})"), F.lit(""))
        bare = F.btrim(F.regexp_replace(raw, r"\[\d+\]|\((?:19|20)\d{2}\)", ""), F.lit(" ,.;"))
        return F.struct(raw.alias("raw"), year.alias("year"), _first(raw, r"(\d+(?:-\d+)?)").alias("page"), F.when(F.length(bare) > 0, bare).otherwise(raw).alias("title"), F.round(F.lit(0.35) + F.when(year.isNotNull(), 0.15).otherwise(0.0), 2).alias("confidence"))

    return F.transform(F.array_distinct(found), parsed)


def mention_edges(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source, target, confidence): a mention (id, title, confidence) whose title is a document's title (id, title), whatever the case.

    Equal titles are what a join can find without comparing every pair; 0.55 at least. Mentions and documents are made distinct before they meet, so that
    edges, as many as the product of both for each title, leave the join as they are; only those to a document of several titles are grouped.
    """
    left = mentions.select(F.col("id").alias("source"), F.lower("title").alias("t"), "confidence").filter(F.length("t") > 0)
    left = left.groupBy("source", "t").agg(F.max("confidence").alias("confidence"))
    right = documents.select(F.col("id").alias("target"), F.lower("title").alias("t")).filter(F.length("t") > 0)
    named = right.groupBy("target").agg(F.min("t").alias("t"), F.max("t").alias("_last"))
    several = right.join(named.filter("t <> _last").select("target"), "target", "left_semi").distinct()
    weight = lambda c: F.greatest(c, F.lit(0.55)).alias("confidence")
    met = lambda docs: left.join(docs, "t").filter("source <> target")
    once = met(named.filter("t = _last").select("target", "t")).select("source", "target", weight(F.col("confidence")))
    return once.unionByName(met(several).groupBy("source", "target").agg(weight(F.max("confidence"))))


def footnote(text: Column) -> Column:
    """Struct of title, author, place, publisher, year, page_label, pages and type of a footnote.

    The title is the first one in title brackets, but an original title in parentheses goes before it. The author is what
    comes before the title; place and publisher are the two sides of the first colon after it.
    """
    text = collapse(text)
    first = collapse(_first(text, "[「『《](.+?)[」』》]"))
    inner = [collapse(_first(text, p)) for p in (r"[（(][^（）()]{0,100}[：:]\s*[「『《](.+?)[」』》][^（）()]{0,100}[）)]", r"[（(]\s*[「『《](.+?)[」』》]\s*[）)]")]
    title = F.coalesce(*[F.when((F.length(t) > 0) & (t != first), t) for t in inner], first)
    at = F.instr(text, title)
    known = (F.length(title) > 0) & (at > 0)
    author = F.btrim(F.substring(text, F.lit(1), at - 1), F.lit("「『《（( ，,。；;:："))
    author = F.when(known, collapse(F.regexp_replace(author, r"(著|编纂|編纂|研究会編|研究會編|编|編)\s*$", ""))).otherwise("")
    after = F.when(known, F.substring(text, at + F.length(title), F.length(text))).otherwise(text)
    colon = r"([^\s、，,。；;:：]{1,20})\s*[：:]\s*([^、，,。；;]{1,40})"
    listed = r"第?\s*(\d+(?:\s*[,，、]\s*\d+)+)\s*[页頁]"
    ranged, single = r"第?\s*(\d+)\s*[-—－~～]\s*(\d+)\s*[页頁]", r"第?\s*(\d+)\s*[页頁]"
    low, high = _first(text, ranged, 1).cast("int"), _first(text, ranged, 2).cast("int")
    numbers = F.transform(F.regexp_extract_all(_first(text, listed), F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    pages = F.when(text.rlike(listed), numbers).when(text.rlike(ranged), F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array(low, high))).when(text.rlike(single), F.array(_first(text, single).cast("int"))).otherwise(F.array().cast("array<int>"))
    label = F.when(text.rlike(listed), _first(text, listed, 0)).when(text.rlike(ranged), _first(text, ranged, 0)).otherwise(_first(text, single, 0))
    lower = F.lower(text)
    kind = F.when(F.contains(lower, F.lit("jacar")) | F.contains(lower, F.lit("ref.")), "archive").when(text.rlike("紀要|学报|期"), "article").otherwise("book")
    return F.struct(title.alias("title"), author.alias("author"), collapse(_first(after, colon, 1)).alias("place"), collapse(_first(after, colon, 2)).alias("publisher"), _first(text, r"(1[89]\d{2}|20\d{2})年").alias("year"), label.alias("page_label"), pages.alias("pages"), kind.alias("type"))


#: Forms of a book's citation, plain, with pages, with an edition, and with both.
BOOKS = {
    "chicago": ("{author}. {title} [M]. {publisher}, {year}.", "{author}. {title} [M]. {publisher}, {year}. pp. {pages}.", "{author}. {title} [M]. {publisher}, {year}. {edition}.", "{author}. {title} [M]. {publisher}, {year}. {edition}. pp. {pages}."),
    "apa": ("{author} ({year}). {title}. {publisher}.", "{author} ({year}). {title}. {publisher}. {pages}p.", "{author} ({year}). {title} ({edition}). {publisher}.", "{author} ({year}). {title} ({edition}). {publisher}. {pages}p."),
    "gb7714": ("[{index}] {author}. {title} [M]. {publisher}, {year}.", "[{index}] {author}. {title} [M]. {publisher}, {year}: {pages}.", "[{index}] {author}. {title} [M]. {publisher}, {year}.", "[{index}] {author}. {title} [M]. {publisher}, {year}: {pages}."),
    "mla": ("{author}. {title} [M]. {publisher}, {year}.", "{author}. {title} [M]. {publisher}, {year}. Print.", "{author}. {title} [M]. {publisher}, {year}.", "{author}. {title} [M]. {publisher}, {year}. Print."),
    "ieee": ("{author}, {title}. {publisher}, {year}.", "{author}, {title}. {publisher}, {year}, pp. {pages}.", "{author}, {title}. {publisher}, {year}.", "{author}, {title}. {publisher}, {year}, pp. {pages}."),
    "harvard": ("{author} ({year}) {title}. {publisher}.", "{author} ({year}) {title}. {publisher}, pp. {pages}.", "{author} ({year}) {title}. {publisher}.", "{author} ({year}) {title}. {publisher}, pp. {pages}."),
}


def rendered_book(style: str, title: Column, author: Column, publisher: Column, year: Column, pages: Column, edition: Column, index: Column) -> Column:
    """A book's citation; unknown author, publisher and year are said so, pages and edition that are blank or 未知 are left out."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    known = lambda c: ~(blank(c) | (c == "未知"))
    values = {
        "author": F.when(known(author), collapse(author)).otherwise("未知作者"),
        "title": F.coalesce(title, F.lit("")),
        "publisher": F.when(blank(publisher), "未知出版社").otherwise(publisher),
        "year": F.when(blank(year), "n.d.").otherwise(year),
        "pages": F.coalesce(pages, F.lit("")),
        "edition": F.coalesce(edition, F.lit("")),
        "index": index.cast("string"),
    }

    def filled(form: str) -> Column:
        pieces = [(text, name) for text, name, _, _ in Formatter().parse(form)]
        return F.concat(*(part for text, name in pieces for part in ([F.lit(text)] if text else []) + ([values[name]] if name else [])))

    plain, paged, again, both = map(filled, BOOKS[style])
    return F.when(known(pages) & known(edition), both).when(known(pages), paged).when(known(edition), again).otherwise(plain)
