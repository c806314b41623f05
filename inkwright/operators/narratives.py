"""Persons, speeches and timelines in running text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import bound

#: First Western year of the eras of a career, in the order in which they are looked for.
CAREER_ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}
#: Patterns of a person block, each list in order.
NAMES = (r"^([一-龥]{2,5})\s*(?:氏|君|name)", r"([一-龥]{2,5})\s*[（(].*?[）)]", r"^([一-龥]{2,5})\s*$")
HOMETOWNS = ((r"本籍[：:]\s*([^\n,，]+)", 1), (r"出身地[：:]\s*([^\n,，]+)", 1), (r"生于[^\n,，]+", 0), (r"出生[^\n,，]+", 0))
EDUCATION = (r"(?:東京大学|東北大|北大|名大|阪大|九大|九州大学| Harvard| Yale| Oxford| Cambridge)", r"卒業[于人]?\s*：?\s*([^\n,，]+)", r"学歴[：:]\s*([^\n]+)", r"(?:学士|修士|博士|学位)", r"教育[：:]\s*([^\n]+)")
CAREER_DATES = (r"(昭和|平成|令和|明治|大正)\s*(\d+)年(?:\s*(\d+)月)?(?:\s*(\d+)日)?", r"(\d{4})年(?:\s*(\d{1,2})月)?(?:\s*(\d{1,2})日)?", r"(\d+)年(?:-\d+年)?")
UNITS = (r"([^\n,，]{2,20}?(?:大学|学校|省|庁|公司|銀行|病院|鉄道|局|部|課))", r"([^\n,，]{2,30}?(?:満鉄|満炭|満業|南満洲鉄道|鞍山製鉄))")
#: Only line feeds end lines, and classes are those of all scripts.
_FLAGS = "(?dU)"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\v\f\r　"))


def _first(text: Column, patterns, group: int | None = None) -> Column:
    """What the first pattern that matches gives: its group, or the one named beside it; null without a match."""
    tried = []
    for p in patterns:
        pattern, at = p if isinstance(p, tuple) else (p, group)
        tried.append(F.when(text.rlike(_FLAGS + pattern), F.regexp_extract(text, _FLAGS + pattern, at)))
    return F.coalesce(*tried)


def career_date(text: Column) -> Column:
    """(year, month, day) of an era date, else of a Western one; a missing month or day is 1. Null without a date."""
    number = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")

    def parts(pattern: str, start: int) -> Column:
        pattern = _FLAGS + pattern
        found = F.struct((number(pattern, 1) + start).alias("year"), F.coalesce(number(pattern, 2), F.lit(1)).alias("month"), F.coalesce(number(pattern, 3), F.lit(1)).alias("day"))
        return F.when(text.rlike(pattern), found)

    eras = [parts(rf"{era}\s*(\d{{1,4}})年(?:\s*(\d{{1,2}})月)?(?:\s*(\d{{1,2}})日)?", first - 1) for era, first in CAREER_ERAS.items()]
    return F.coalesce(*eras, parts(r"(\d{4})年(?:\s*(\d{1,2})月)?(?:\s*(\d{1,2})日)?", 0))


def person_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Blocks that name a person or a career, with name, hometown, education and experiences (unit, date_range, start, stop, description).

    Experiences are lines of five characters or more with a date and a unit, by start, undated ones last. A hometown pattern without a part of its own gives the
    whole match. Null texts give nothing.
    """
    t = F.col(text)
    lines = F.filter(F.transform(F.split(t, "\n"), _stripped), lambda x: x != "")
    names = F.transform(F.concat(F.array(t), lines), lambda x: _first(x, NAMES, 1))
    name = F.get(F.filter(names, lambda n: F.length(_stripped(n)).between(2, 5)), F.lit(0))

    def experience(line: Column) -> Column:
        def dated(date: Column, ends: Column) -> Column:
            stop = F.when(F.size(ends) >= 2, F.get(ends, F.lit(1))).otherwise(F.get(ends, F.lit(0)))
            return F.struct(_stripped(_first(line, UNITS, 1)).alias("unit"), date.alias("date_range"), F.get(ends, F.lit(0)).alias("start"), stop.alias("stop"), _stripped(line).alias("description"))

        ends = lambda date: F.transform(F.split(date, "[-–—]"), lambda d: career_date(_stripped(d)))
        return bound(_first(line, CAREER_DATES, 0), lambda date: bound(ends(date), lambda e: dated(date, e)))

    dated = F.filter(F.transform(F.filter(F.split(t, "\n"), lambda x: F.length(_stripped(x)) >= 5), experience), lambda e: e["date_range"].isNotNull() & e["unit"].isNotNull())
    never = F.struct(F.lit(9999).alias("year"), F.lit(12).alias("month"), F.lit(31).alias("day"))
    keyed = F.transform(dated, lambda e, k: F.struct(F.coalesce(e["start"], never).alias("by"), k.alias("k"), e.alias("e")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["e"])
    out = blocks.filter(t.isNotNull()).withColumns({"name": _stripped(name), "hometown": _stripped(_first(t, HOMETOWNS)), "education": _stripped(_first(t, EDUCATION, 0)), "experiences": ordered})
    return out.filter(F.col("name").isNotNull() | (F.size("experiences") > 0))


def person_summary(blocks: DataFrame, persons: DataFrame, text: str = "text") -> DataFrame:
    """One row: blocks, persons, those with a name and with experiences, and sorted flags."""
    counts = blocks.agg(F.count("*").alias("blocks"), F.count_if(_stripped(F.coalesce(text, F.lit(""))) == "").alias("_blank"))
    found = persons.agg(F.count("*").alias("persons"), F.count_if(F.coalesce("name", F.lit("")) != "").alias("named"), F.count_if(F.size("experiences") > 0).alias("careers"))
    both = counts.join(found)  # one row each
    flags = F.array(F.when((F.col("blocks") > 0) & (F.col("_blank") > 0), "empty_text_blocks"), F.when((F.col("blocks") > 0) & (F.col("persons") == 0), "no_biography_entities"), F.when(F.col("blocks") == 0, "no_text_blocks"), F.when(F.col("named") < F.col("persons"), "person_missing_name"), F.when(F.col("careers") < F.col("persons"), "person_missing_work_experiences"))
    return both.select("blocks", "persons", "named", "careers", F.array_compact(flags).alias("flags"))


#: Patterns of speech with their kinds, and what stands before a speech after its speaker's name, each in order.
SPEECHES = ((r"「([^」]+)」", "直接引语"), (r"『([^』]+)』", "引用文献"), (r"（(.+?)）", "括号注释"), (r"\((.+?)\)", "括号注释"), (r"「(.+?)」", "直接引语"), (r"曰く、?(.+?)(?:と|云|言|述)", "间接引语"), (r"(.+?)と申候", "正式陈述"), (r"(.+?)と申上候", "正式陈述"), (r"(.+?)候", "古文陈述"))
SPEAKERS = (r"(.+?)(?:曰|云|言|述|申|書|寄せ)", r"(.+?)殿", r"(.+?)卿", r"(.+?)公", r"(.+?)氏", r"(.+?)閣下", r"(.+?)より", r"(.+?)よりの書", r"(.+?)の書")
_PLACED = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("before", StringType())]))
_ANYWHERE = "(.+?)"


def _matches(pattern: str, text: str) -> Iterator[re.Match]:
    """All matches in order; a pattern that may begin anywhere is tried up to the last place of its ending in a line, so no line is read again and again."""
    compiled = re.compile(pattern)
    if not pattern.startswith(_ANYWHERE):
        yield from compiled.finditer(text)
        return
    ending, at = pattern[len(_ANYWHERE) :], 0
    while (hit := text.find(ending, at)) >= 0:
        stop = text.find("\n", hit)
        at = len(text) if stop < 0 else stop
        yield from compiled.finditer(text, text.rfind("\n", 0, hit) + 1, text.rfind(ending, hit, at) + len(ending))


def _placed_speeches(near: int):
    @F.pandas_udf(_PLACED)
    def placed(texts: pd.Series) -> pd.Series:
        """Matches of all patterns with their places and the text before them, which built-ins do not give."""
        return pd.Series([[{"kind": kind, "text": m.group(1).strip(), "start": m.start(), "stop": m.end(), "before": text[max(0, m.start() - near) : m.start()]} for p, kind in SPEECHES for m in _matches(p, text or "")] for text in texts])

    return placed


def speeches(docs: DataFrame, key: str, text: str = "text", near: int = 100) -> DataFrame:
    """(key, place, kind, text, start, stop, speaker, confidence) of every match of every pattern, in order of pattern and place.

    The speaker is named within the `near` characters before, by the first pattern that gives a name of 20 characters or fewer; else it is empty.
    Patterns overlap, so one passage may be several speeches. Null texts give none. A name is the last line that is not blank, up to the ending.
    """
    rows = docs.select(key, F.posexplode(_placed_speeches(near)(text)).alias("place", "_s"))
    rows = rows.withColumn("_line", F.substring_index(F.regexp_replace("_s.before", _FLAGS + r"\s+$", ""), "\n", -1))
    tried = []
    for pattern in SPEAKERS:
        endings = pattern.removeprefix(_ANYWHERE).removeprefix("(?:").removesuffix(")").split("|")
        found = F.coalesce(*[F.when(F.endswith("_line", F.lit(e)), F.left("_line", F.length("_line") - len(e))) for e in endings])
        found = F.regexp_replace(found, r"[　\s]+", "")
        tried.append(F.when(F.length(found).between(1, 20), found))
    speaker = F.coalesce(*tried, F.lit(""))
    return rows.select(key, "place", "_s.kind", "_s.text", "_s.start", "_s.stop", speaker.alias("speaker")).withColumn("confidence", F.when(F.col("speaker") != "", 0.8).otherwise(0.6))


#: Dated lines, in order, with the number of their groups; years anywhere, if no dated line is found.
DATED = ((r"(\d{4}[年\-]\d{1,2}[月\-]?\d{0,2}[日]?)[：:、](.+)", 2), (r"(.*?)(\d{4})[年](.*)", 3), (r"(.*?)(\d{1,2})[/年](\d{1,2})[日]?(.*)", 4))
YEARS = r"(\d{4})[年\-]?(\d{1,2})?[月\-]?(\d{1,2})?[日]?"


def timeline(text: Column) -> Column:
    """(date, event) of the first usable match of each of three patterns; without any, of every year with the 50 characters from its first place.

    A match's last group is the event, or its first one where that is empty; what stands before belongs to the date.
    """

    def first(pattern: str, n: int) -> Column:
        def event(r: Column) -> Column:
            said = F.when(r[f"g{n - 1}"] != "", r[f"g{n - 1}"]).otherwise(r["g0"])
            return F.struct(F.concat(*(r[f"g{k}"] for k in range(n - 1))).alias("date"), said.alias("event"))

        groups = [F.regexp_extract_all(text, F.lit("(?d)" + pattern), k + 1).alias(f"g{k}") for k in range(n)]
        return F.slice(F.filter(F.transform(F.arrays_zip(*groups), event), lambda e: (e["date"] != "") & (e["event"] != "")), 1, 1)

    dated = F.transform(F.flatten(F.array(*(first(pattern, n) for pattern, n in DATED))), lambda e: F.struct(_stripped(e["date"]).alias("date"), _stripped(e["event"]).alias("event")))
    years = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(YEARS), k).alias(f"g{k}") for k in (1, 2, 3)))

    def year(r: Column) -> Column:
        date = F.concat(r["g1"], *(F.when(r[g] != "", F.concat(F.lit("-"), r[g])).otherwise("") for g in ("g2", "g3")))
        return F.struct(date.alias("date"), F.substring(text, F.call_function("instr", text, r["g1"]), F.lit(50)).alias("event"))

    return F.when(F.size(dated) > 0, dated).otherwise(F.transform(years, year))
