"""Regnal eras, kanji numerals, page arithmetic, recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: First Western year of each era.
ERAS = {"天保": 1830, "弘化": 1844, "嘉永": 1848, "安政": 1854, "文久": 1861, "元治": 1864, "慶応": 1865, "慶應": 1865, "明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}
#: Kanji digits and units.
DIGITS = {"〇": 0, "零": 0, "元": 1, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def era_year(era: Column, year: Column) -> Column:
    """Western year of the given year of an era; null for an unknown era."""
    start = F.element_at(F.create_map(*[x for name, first in ERAS.items() for x in (F.lit(name), F.lit(first))]), era)
    return start + year.cast("int") - 1


def kanji_number(text: Column) -> Column:
    """Value of digits (read by place) or kanji numerals up to thousands; 廿 is 20 and 卅 30. Null if anything else is in it."""
    return bound(text, _numeral)


def _numeral(text: Column) -> Column:
    plain = F.translate(F.replace(F.replace(text, F.lit("廿"), F.lit("二十")), F.lit("卅"), F.lit("三十")), "".join(DIGITS), "".join(map(str, DIGITS.values())))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digits"), F.lit(False).alias("seen"))

    def step(s: Column, c: Column) -> Column:
        d, u = c.try_cast("int"), F.when(c == "十", UNITS["十"]).when(c == "百", UNITS["百"]).otherwise(UNITS["千"])
        on_digit = F.struct(s["total"].alias("total"), (s["digits"] * 10 + d).alias("digits"), F.lit(True).alias("seen"))
        on_unit = F.struct((s["total"] + F.when(s["seen"], s["digits"]).otherwise(1) * u).alias("total"), F.lit(0).alias("digits"), F.lit(False).alias("seen"))
        return F.when(c.isin(*UNITS), on_unit).otherwise(on_digit)

    value = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), start, step, lambda s: s["total"] + s["digits"])
    # Few digits are a number as they stand.
    return bound(plain, lambda t: F.when(t.rlike("^[0-9]{1,9}$"), t.cast("int")).when(t.rlike("^[0-9十百千]+$"), value(t)))


def to_kanji(number: Column) -> Column:
    """1 to 9999 in kanji numerals."""
    names = F.array(*[F.lit(x) for x in ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")])

    def place(size: int, mark: str) -> Column:
        digit = F.floor(number / size).cast("int") % 10
        return F.when(digit == 0, "").when((digit == 1) & F.lit(bool(mark)), mark).otherwise(F.concat(F.get(names, digit), F.lit(mark)))

    return F.when((number > 0) & (number < 10000), F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, "")))


def era_dates(text: Column) -> Column:
    """(era, era_year, month, day, year) of every full regnal date."""
    pattern = f"({'|'.join(ERAS)})([0-9元一二三四五六七八九十百廿卅]+)年([0-9一二三四五六七八九十]+)月([0-9一二三四五六七八九十廿卅]+)日"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)

    def parts(d: Column) -> Column:
        era, year = F.regexp_extract(d, pattern, 1), kanji_number(F.regexp_extract(d, pattern, 2))
        return F.struct(era.alias("era"), year.alias("era_year"), kanji_number(F.regexp_extract(d, pattern, 3)).alias("month"), kanji_number(F.regexp_extract(d, pattern, 4)).alias("day"), era_year(era, year).alias("year"))

    return F.transform(found, parts)


def date_key(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def recency_score(published: Column, as_of: Column) -> Column:
    days = F.date_diff(as_of, published)
    return F.when(days.isNull(), 60.0).when(days < 30, 95.0).when(days < 90, 85.0).when(days < 180, 75.0).when(days < 365, 65.0).otherwise(55.0)


def popularity_score(stars: Column, forks: Column, watchers: Column, digits: int = 2) -> Column:
    return F.round(F.least(stars / 10000, F.lit(1.0)) * 40 + F.least(forks / 2000, F.lit(1.0)) * 35 + F.least(watchers / 5000, F.lit(1.0)) * 25, digits)


def scan_page(book_page: Column, anchor_scan: Column, anchor_book: Column, per_scan: Column) -> Column:
    """Scan that holds a book page when scans show `per_scan` pages each and `anchor_scan` begins with `anchor_book`; null for pages before it."""
    return F.when(book_page >= anchor_book, anchor_scan + F.floor((book_page - anchor_book) / F.greatest(per_scan, F.lit(1))).cast("int"))


def book_pages(scan: Column, anchor_scan: Column, anchor_book: Column, per_scan: Column) -> Column:
    """Book pages on a scan, the way back from `scan_page`; none for scans before the anchor."""
    per = F.greatest(per_scan, F.lit(1))
    first = (anchor_book + (scan - anchor_scan) * per).cast("int")
    return F.when(scan >= anchor_scan, F.sequence(first, first + per.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def page_window(page: Column, window: int) -> Column:
    """The page, then those around it by distance, the earlier one first."""
    return F.array(page, *[page + sign * k for k in range(1, window + 1) for sign in (-1, 1)])


def page_list(label: Column) -> Column:
    """Sorted distinct pages of a label such as "3, 5-8"; a range that runs backwards gives none."""
    parts = F.filter(F.transform(F.split(label, "[,，、;；]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*[-–~]\s*\d+)?$"))

    def pages(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(p, r"(\d+)$", 1), F.lit("")).cast("int"), low)
        return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def page_span(pages: Column, explicit_list: Column, comma_count: Column, unit_type: Column, explicit_range: Column) -> Column:
    """unmarked, single_page, distributed_pages, continuous_range or range_context."""
    n = F.size(pages)
    consecutive = (F.array_max(pages) - F.array_min(pages) + 1) == n
    return (
        F.when(n == 0, "unmarked")
        .when(n == 1, "single_page")
        .when(explicit_list | ~consecutive, "distributed_pages")
        .when(n == 2, "continuous_range")
        .when((unit_type == "direct_quote") & explicit_range, "continuous_range")
        .when(comma_count >= 2, "distributed_pages")
        .otherwise("range_context")
    )


#: Last Western year of an era, in the order in which a year is looked up.
ERA_ENDS = {"明治": 1912, "大正": 1926, "昭和": 1989, "平成": 2019, "令和": 2026, "慶応": 1868, "慶應": 1868, "元治": 1865, "文久": 1864, "安政": 1860, "嘉永": 1854}
_NAMED_ERAS = "(" + "|".join(ERA_ENDS) + ")"
_KANJI = "([一二三四五六七八九十]+)"
#: The kinds of dates that are looked for, and how sure they are: which groups are era, year, month and day.
DATE_KINDS = {
    "full_date": (_NAMED_ERAS + r"(\d+|元)年(\d+)月(\d+)日", (1, 2, 3, 4), 0.95),
    "year_month": (_NAMED_ERAS + r"(\d+|元)年(\d+)月", (1, 2, 3, 0), 0.90),
    "era_year": (_NAMED_ERAS + r"(\d+|元)年", (1, 2, 0, 0), 0.85),
    "era_year_short": (_NAMED_ERAS + r"(\d+)", (1, 2, 0, 0), 0.80),
    "western_full_date": (r"(\d{4})年(\d{1,2})月(\d{1,2})日", (0, 1, 2, 3), 0.95),
    "western_year_month": (r"(\d{4})年(\d{1,2})月", (0, 1, 2, 0), 0.90),
    "western_year": (r"(\d{4})年", (0, 1, 0, 0), 0.85),
    "full_date_space": (_NAMED_ERAS + r"(\d+|元)年\s*(\d+)月\s*(\d+)日", (1, 2, 3, 4), 0.95),
    "kanji_month_day": (_KANJI + "月" + _KANJI + "日", (0, 0, 1, 2), 0.70),
    "month_day": (r"(\d{1,2})月(\d{1,2})日", (0, 0, 1, 2), 0.75),
}


def text_dates(text: Column) -> Column:
    """(kind, text, era, year, month, day, confidence) of every match of every kind, kind by kind; overlapping ones all stay."""

    def found(kind: str) -> Column:
        pattern, (era, year, month, day), sure = DATE_KINDS[kind]

        # One pass over the text for each group, instead of one over each match.
        matches = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), g).alias(f"g{g}") for g in sorted({0, era, year, month, day})))

        def parsed(d: Column) -> Column:
            def number(group: int) -> Column:
                return kanji_number(d[f"g{group}"]).cast("int") if group else F.lit(None).cast("int")

            name = d[f"g{era}"] if era else F.lit(None).cast("string")
            western = era_year(name, number(year)).cast("int") if era else number(year)
            return F.struct(F.lit(kind).alias("kind"), d["g0"].alias("text"), name.alias("era"), western.alias("year"), number(month).alias("month"), number(day).alias("day"), F.lit(sure).alias("confidence"))

        return F.transform(matches, parsed)

    return F.concat(*[found(kind) for kind in DATE_KINDS])


def era_of_year(year: Column) -> Column:
    """The first era, in the order of ERA_ENDS, whose years hold the given one."""
    return F.coalesce(*[F.when((year >= ERAS[era]) & (year <= end), era) for era, end in ERA_ENDS.items()])


def wareki_date(text: Column) -> Column:
    """(year, month, day) of the first regnal date, else of the first Western one; a month or day that is not told is 1."""
    eras = "(明治|大正|昭和|平成|令和)"
    regnal = eras + r"\s*(\d+)年(?:\s*(\d+)月)?(?:\s*(\d+)日)?"
    western = r"(\d{4})年(?:\s*(\d{1,2})月)?(?:\s*(\d{1,2})日)?"

    def number(pattern: str, group: int) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9999999")).cast("int")

    def date(year: Column, pattern: str, at: int) -> Column:
        return F.struct(year.cast("int").alias("year"), F.coalesce(number(pattern, at), F.lit(1)).alias("month"), F.coalesce(number(pattern, at + 1), F.lit(1)).alias("day"))

    return F.when(text.rlike(regnal), date(era_year(F.regexp_extract(text, regnal, 1), number(regnal, 2)), regnal, 3)).when(text.rlike(western), date(number(western, 1), western, 2))


def date_range(text: Column) -> Column:
    """(start, stop) of a range with a dash; a single date is both."""
    parts = F.split(text, "[-–—]")
    return F.struct(wareki_date(F.trim(parts[0])).alias("start"), wareki_date(F.trim(F.coalesce(F.get(parts, F.lit(1)), parts[0]))).alias("stop"))


def title_era_years(text: Column) -> Column:
    """Different "era year" strings of a title, as 明治5."""
    pattern = r"(明治|大正|昭和|平成|令和)\s*([0-9]+|元)\s*年?"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda d: F.concat(F.regexp_extract(d, pattern, 1), F.replace(F.regexp_extract(d, pattern, 2), F.lit("元"), F.lit("1")))))


def era_years_agree(left: Column, right: Column) -> Column:
    """Null unless both titles name years of one era; then whether they share one."""
    a, b = title_era_years(left), title_era_years(right)
    eras = lambda x: F.transform(x, lambda d: F.substring(d, 1, 2))
    return F.when(F.arrays_overlap(eras(a), eras(b)), F.arrays_overlap(a, b))


def dated_days(text: Column) -> Column:
    """(year, month, day) of every month and day, kanji ones first, under the first year of 明治 or else 大正; none without such a year."""
    bare = F.regexp_replace(text, r"\s+", "")
    years = [("明治", f"明治{_KANJI}年"), ("明治", r"明治(\d+)年"), ("大正", f"大正{_KANJI}年"), ("大正", r"大正(\d+)年")]
    year = F.coalesce(*[F.when(bare.rlike(p), F.lit(ERAS[era] - 1) + kanji_number(F.regexp_extract(bare, p, 1))) for era, p in years])

    def days(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(bare, F.lit(pattern), 0), lambda d: F.struct(kanji_number(F.regexp_extract(d, pattern, 1)).alias("month"), kanji_number(F.regexp_extract(d, pattern, 2)).alias("day")))

    found = F.concat(days(f"{_KANJI}月{_KANJI}日"), days(r"(\d+)月(\d+)日"))
    return F.when(year.isNotNull(), F.transform(found, lambda d: F.struct(year.cast("int").alias("year"), d["month"].cast("int").alias("month"), d["day"].cast("int").alias("day"))))


#: Forms of a source's dates, in order, and the years of eras that a Western year may belong to.
SOURCE_DATES = (r"(?:1[89]\d{2}|20\d{2})\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", r"(?:明治|大正|昭和|平成|令和)\s*[0-9一二三四五六七八九十百元]+\s*年\s*(?:\d{1,2})?\s*月?\s*(?:\d{1,2})?\s*日?", r"(?:1[89]\d{2}|20\d{2})\s*年")
ERA_YEARS = (("明治", 1868, 1912), ("大正", 1912, 1926), ("昭和", 1926, 1989), ("平成", 1989, 2019), ("令和", 2019, 2100))


def source_dates(text: Column, most: int = 8) -> Column:
    """Different dates of a source's texts as they stand, by form and place. Width forms are left to `evidence.nfkc`."""
    return F.slice(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in SOURCE_DATES]))), 1, most)


def era_variants(text: Column) -> Column:
    """Each Western date in the eras that its year belongs to, with the year in digits and in kanji (and 元 for a first one), each once."""
    pattern = F.lit(r"(1[89]\d{2}|20\d{2})\s*年(?:\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?)?")
    found = F.arrays_zip(*(F.regexp_extract_all(text, pattern, k).alias(f"g{k}") for k in (1, 2, 3)))

    def forms(d: Column) -> Column:
        number = lambda c, mark: F.when(c != "", F.concat(c.cast("int").cast("string"), F.lit(mark))).otherwise("")
        rest = F.concat(F.lit("年"), number(d["g2"], "月"), number(d["g3"], "日"))

        def era(name: str, first: int, last: int) -> Column:
            year = d["g1"].cast("int") - (first - 1)
            names = F.when(year == 1, F.array(F.lit("元"), F.lit("1"), F.lit("一"))).otherwise(F.array(year.cast("string"), to_kanji(year)))
            spelt = F.transform(names, lambda y: F.concat(F.lit(name), y, rest))
            return F.when(d["g1"].cast("int").between(first, last), spelt).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[era(*e) for e in ERA_YEARS]))

    return F.array_distinct(F.flatten(F.transform(found, forms)))
