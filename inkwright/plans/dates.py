"""Queries for dates in text, over strings made of the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import evidence as V
from ..operators.spread import spread
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ERAS = ["明治", "大正", "昭和", "平成", "令和", "慶応", "慶應", "元治", "文久", "安政", "嘉永"]
_STARTS = [1868, 1912, 1926, 1989, 2019, 1865, 1865, 1864, 1861, 1854, 1848]
_ENDS = [1912, 1926, 1989, 2019, 2026, 1868, 1868, 1865, 1864, 1860, 1854]
_ERA = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN '{era}'" for k, era in enumerate(_ERAS)) + " END"
#: Dates in several forms, as SQL that both engines read.
_TEXT = f"concat({_ERA}, 1 + p_size % 20, '年', 1 + p_size % 12, '月', 1 + p_size % 28, '日と', {_ERA}, '元年 ', 1 + p_size % 9, '月 ', 1 + p_size % 7, '日、', 1850 + p_size, '年', 1 + p_size % 12, '月', CASE WHEN p_size % 2 = 0 THEN '三日' ELSE '5日' END, '、十一月二十', CASE WHEN p_size % 3 = 0 THEN '一' ELSE '' END, '日、', {_ERA}, p_size)"


def _year(era: str, n: str) -> str:
    return f"CASE {era} " + " ".join(f"WHEN '{e}' THEN {s}" for e, s in zip(_ERAS, _STARTS)) + f" END + {n} - 1"


def _number(x: str) -> str:
    digit = "CASE {0} " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate("一二三四五六七八九", 1)) + " ELSE 0 END"
    tens = f"CASE WHEN contains({x}, '十') THEN CASE WHEN {x}[1] = '十' THEN 10 ELSE 10 * {digit.format(x + '[1]')} END ELSE 0 END"
    return f"CASE WHEN {x} = '元' THEN 1 WHEN regexp_matches({x}, '^[0-9]+$') THEN TRY_CAST({x} AS INTEGER) ELSE {tens} + CASE WHEN {x}[-1] = '十' THEN 0 ELSE {digit.format(x + '[-1]')} END END"


def _kind(kind: str) -> str:
    pattern, (era, year, month, day), sure = D.DATE_KINDS[kind]
    group = lambda g: f"regexp_extract(d, '{pattern}', {g})"
    number = lambda g: _number(group(g)) if g else "NULL"
    western = _year(group(era), f"({number(year)})") if era else number(year)
    return f"SELECT p_partkey, '{kind}' AS kind, d AS text, COALESCE({western}, -1) AS year, COALESCE({number(month)}, -1) AS month, COALESCE({number(day)}, -1) AS day, {sure}::DOUBLE AS confidence FROM (SELECT p_partkey, unnest(regexp_extract_all(t, '{pattern}')) AS d FROM t)"


_DATES = f"WITH t AS (SELECT p_partkey, {_TEXT} AS t FROM part), dates AS ({' UNION ALL '.join(map(_kind, D.DATE_KINDS))})"


def _dates(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(_TEXT).alias("t"))
    return texts.select("p_partkey", F.explode(D.text_dates(F.col("t"))).alias("d")).select("p_partkey", "d.*")


@query(f"{_DATES} SELECT p_partkey, kind, text, year::INT AS year, month::INT AS month, day::INT AS day, confidence FROM dates")
def d02_text_dates(spark, sf_dir):
    return _dates(spark, sf_dir).drop("era").fillna(-1, ["year", "month", "day"])


@query(f"{_DATES} SELECT p_partkey, max(year)::INT AS year, CASE {' '.join(f'WHEN max(year) BETWEEN {a} AND {b} THEN {chr(39)}{e}{chr(39)}' for e, a, b in zip(_ERAS, _STARTS, _ENDS))} END AS era FROM dates WHERE year > 0 GROUP BY 1")
def g13_publication_year(spark, sf_dir):
    return V.publication_year(_dates(spark, sf_dir), "p_partkey")


_RANGE = f"concat(CASE p_partkey % 4 WHEN 0 THEN concat('昭和', 1 + p_size, '年') WHEN 1 THEN concat('大正 ', 1 + p_size % 14, '年 ', 1 + p_size % 12, '月') WHEN 2 THEN concat(1900 + p_size, '年', 1 + p_size % 12, '月', 1 + p_size % 28, '日') ELSE 'none' END, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('-', 1950 + p_size, '年') END)"


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1926 + p_size WHEN 1 THEN 1912 + p_size % 14 WHEN 2 THEN 1900 + p_size ELSE -1 END::INT AS start_year, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 3 THEN -1 ELSE 1 + p_size % 12 END::INT AS start_month, CASE p_partkey % 4 WHEN 2 THEN 1 + p_size % 28 WHEN 3 THEN -1 ELSE 1 END::INT AS start_day, CASE WHEN p_size % 3 > 0 THEN 1950 + p_size ELSE CASE p_partkey % 4 WHEN 0 THEN 1926 + p_size WHEN 1 THEN 1912 + p_size % 14 WHEN 2 THEN 1900 + p_size ELSE -1 END END::INT AS stop_year FROM part")
def d04_date_range(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", D.date_range(F.expr(_RANGE)).alias("r"))
    return r.select("p_partkey", *[F.coalesce(F.col(c), F.lit(-1)).alias(n) for n, c in (("start_year", "r.start.year"), ("start_month", "r.start.month"), ("start_day", "r.start.day"), ("stop_year", "r.stop.year"))])


_TITLES = ("concat('史料 昭和', 1 + p_size % 5, '年 大正', 1 + p_size % 3)", "concat(CASE WHEN p_size % 4 = 0 THEN '平成9年' ELSE concat('昭和', 1 + p_size % 3, '年') END, p_name)")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 5 = p_size % 3 THEN 'agree' ELSE 'conflict' END AS eras FROM part")
def u03_era_years_agree(spark, sf_dir):
    a = D.era_years_agree(F.expr(_TITLES[0]), F.expr(_TITLES[1]))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(a.isNull(), "unknown").when(a, "agree").otherwise("conflict").alias("eras"))


@query("SELECT p_partkey, '昭和' || (1 + p_size % 5) || ',大正' || (1 + p_size % 3) AS era_years FROM part")
def d07_title_era_years(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(D.title_era_years(F.expr(_TITLES[0])), ",").alias("era_years"))


@query("SELECT l_orderkey AS page, date_key, annotation_page, annotation_text FROM (SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS date_key FROM lineitem) JOIN (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_key, min(o_orderkey) AS annotation_page, arg_min(o_orderpriority, o_orderkey) AS annotation_text FROM orders GROUP BY 1) USING (date_key)")
def j01_matched_dates(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_key"), F.col("o_orderpriority").alias("text"))
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_key")).distinct()
    return V.matched_dates(notes, sources)
