"""Queries for citations and footnotes, over strings made of the tables' names and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Citation strings in five forms, as SQL that both engines read; n is the key of the part.
_TEXT = """CASE p_partkey % 5
 WHEN 0 THEN concat('Smith, John and Lee, Ann (', 1950 + p_size, '). "The ', p_name, ' study." Journal of ', p_type, ' Works, vol. ', 1 + p_size % 9, ', no. ', 1 + p_size % 4, ', pp. ', p_size, '-', p_size + 12, '. doi: 10.1234/ab.', p_partkey, '.')
 WHEN 1 THEN concat('Tanaka ', p_brand, '. A ', p_name, ' history. ', p_type, ' Press, ', 1960 + p_size, '.')
 WHEN 2 THEN concat('Garcia, M.; Wu, L. ', 1970 + p_size, '. ', p_name, ' reports. Proceedings of ', p_type, ', ', p_size, '(', 1 + p_size % 6, '), ', p_size, '-', p_size + 3, '. https://example.org/', p_partkey, '.')
 WHEN 3 THEN concat('   ', p_name, '  without   a year   ')
 ELSE concat('Old ', p_brand, ' (', 2000 + p_size % 20, 'b) "', p_name, '" ', p_type) END"""


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0B 　]+', ' ', 'g'))"


def _bare(x: str) -> str:
    return f"trim({x}, ' .,:;[]()')"


def _drop(x: str, part: str) -> str:
    return f"CASE WHEN {part} <> '' AND instr({x}, {part}) > 0 THEN substr({x}, 1, instr({x}, {part}) - 1) || ' ' || substr({x}, instr({x}, {part}) + length({part})) ELSE {x} END"


def _parts(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\.\\s+|,\\s+'), lambda p: {_bare('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:vol|no|pp|doi|http)') AND NOT regexp_matches(p, '^\\d+(-\\d+)?$'))"


_RECORDS = f"""
WITH t AS (SELECT p_partkey, {_clean(_TEXT)} AS t FROM part),
y AS (SELECT *, regexp_extract(t, '\\b((?:19|20)\\d{{2}}[a-z]?)\\b', 1) AS year FROM t),
a AS (SELECT *, list_slice(list_filter(list_transform(regexp_split_to_array(trim(regexp_split_to_array({_bare("CASE WHEN year <> '' THEN substr(t, 1, instr(t, year) - 1) ELSE t END")}, '["“]')[1]), '\\s+and\\s+|,\\s*&\\s*|,\\s+and\\s+|;|，|、'), lambda x: {_bare('x')}), lambda x: x <> ''), 1, 6) AS authors FROM y),
b AS (SELECT *, array_to_string(authors, ', ') AS joined FROM a),
r AS (SELECT *, CASE WHEN len(authors) > 0 AND starts_with(t, joined) THEN substr(t, length(joined) + 1) ELSE t END AS rest FROM b),
v AS (SELECT *, {_drop('rest', 'year')} AS rest2 FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(t, '["“].+?["”]') THEN trim(regexp_extract(t, '["“](.+?)["”]', 1), ' .') ELSE COALESCE(list_filter({_parts('rest2')}, lambda p: length(p) >= 3)[1], '') END AS title,
  rtrim(regexp_extract(t, '(?i)(10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '.,;)') AS doi, rtrim(regexp_extract(t, '(?i)(https?://[^\\s]+)', 1), '.,;)') AS url FROM v),
w AS (SELECT *, {_drop('t', 'title')} AS w1 FROM k),
x AS (SELECT *, {_drop('w1', 'year')} AS w2 FROM w),
z AS (SELECT *, replace(replace(w2, CASE WHEN doi = '' THEN chr(1) ELSE doi END, ' '), CASE WHEN url = '' THEN chr(1) ELSE url END, ' ') AS w3 FROM x),
rec AS (SELECT *, COALESCE(list_filter({_parts('w3')}, lambda p: NOT list_contains(authors, p) AND p <> title AND p <> year)[1], '') AS container,
  regexp_replace(regexp_extract(t, '(?i)(?:pp?\\.?\\s*)?(\\d+\\s*[-–]\\s*\\d+)', 1), '\\s+', '', 'g') AS pages, regexp_extract(t, '(?i)vol\\.?\\s*(\\d+)', 1) AS volume,
  COALESCE(nullif(regexp_extract(t, '(?i)no\\.?\\s*(\\d+)', 1), ''), regexp_extract(t, '\\b\\d+\\((\\d+)\\)', 1)) AS issue,
  CASE WHEN regexp_matches(lower(t), 'press|publisher') THEN 'book' WHEN regexp_matches(lower(t), 'thesis|dissertation') THEN 'thesis' WHEN regexp_matches(lower(t), 'proceedings|conference') THEN 'conference' WHEN regexp_matches(lower(t), 'vol\\.\\s*\\d+|no\\.\\s*\\d+|journal') THEN 'article' WHEN regexp_matches(lower(t), 'http|doi') THEN 'electronic' ELSE 'article' END AS type FROM z)
"""


def _records(spark, sf_dir):
    return C.citation_records(table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXT).alias("citation")), "citation").select("p_partkey", F.col("record").alias("r"))


@query(_RECORDS + "SELECT p_partkey, type, joined AS authors, year, title, pages, volume, issue, doi, url, container FROM rec")
def e01_citation_record(spark, sf_dir):
    r = _records(spark, sf_dir).select("p_partkey", "r.*")
    return r.withColumn("authors", F.array_join("authors", ", "))


@query(_RECORDS + "SELECT p_partkey, round(least(0.95, 0.25 + 0.18 * ((title <> '')::INT + (len(authors) > 0)::INT + (year <> '')::INT) + 0.05 * ((pages <> '')::INT + (volume <> '')::INT + (issue <> '')::INT + (doi <> '')::INT + (url <> '')::INT + (container <> '')::INT)), 2) AS confidence FROM rec")
def e03_record_confidence(spark, sf_dir):
    return _records(spark, sf_dir).select("p_partkey", C.record_confidence(F.col("r")).alias("confidence"))


@query(_RECORDS + "SELECT p_partkey, array_to_string(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN len(authors) = 0 THEN 'authors' END, CASE WHEN year = '' THEN 'year' END], lambda i: i IS NOT NULL), ',') AS missing, CASE WHEN year <> '' AND NOT regexp_matches(year, '^\\d{4}$') THEN 1 ELSE 0 END AS warnings FROM rec")
def f15_field_issues(spark, sf_dir):
    return _records(spark, sf_dir).select("p_partkey", C.field_issues(F.col("r")).alias("i")).select("p_partkey", F.array_join("i.missing", ",").alias("missing"), F.size("i.warnings").alias("warnings"))


_OR = "CASE WHEN len(authors) > 0 THEN joined ELSE 'Unknown' END AS au, CASE WHEN title <> '' THEN title ELSE 'Untitled' END AS ti, CASE WHEN container <> '' THEN container ELSE 'Unknown' END AS pl, CASE WHEN year <> '' THEN year ELSE 'n.d.' END AS ye"


@query(_RECORDS + f"""SELECT p_partkey,
 replace(replace(au || '. "' || ti || '." ' || pl || ', ' || ye || ', ' || volume || '(' || issue || '): ' || pages || '.', ' ,', ','), '()', '') AS chicago,
 replace(replace(au || ' (' || ye || '). ' || ti || '. ' || pl || ', ' || volume || '(' || issue || '), ' || pages || '.', ' ,', ','), '()', '') AS apa,
 replace(replace(au || '. "' || ti || '." ' || pl || ', vol. ' || volume || ', no. ' || issue || ', ' || ye || ', pp. ' || pages || '.', 'vol. ,', ''), 'no. ,', '') AS mla,
 replace(replace('[' || p_partkey || '] ' || au || '. ' || ti || '[J]. ' || pl || ', ' || ye || ', ' || volume || '(' || issue || '): ' || pages || '.', ' ,', ','), '()', '') AS gb7714,
 replace(replace('[' || p_partkey || '] ' || au || ', "' || ti || '," ' || pl || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || ', ' || ye || '.', 'vol. ,', ''), 'no. ,', '') AS ieee,
 replace(au || ' (' || ye || ') ' || ti || '. ' || pl || ', pp. ' || pages || '.', ', pp. .', '.') AS harvard FROM (SELECT *, {_OR} FROM rec)""")
def e04_rendered(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("p_partkey", *[C.rendered(F.col("r"), style, F.col("p_partkey")).alias(style) for style in ("chicago", "apa", "mla", "gb7714", "ieee", "harvard")])


_MENTIONS = "concat('As ', p_name, ' says (Smith', CASE WHEN p_size % 2 = 0 THEN ' et al.,' ELSE '' END, ' ', 1950 + p_size, ') and [', p_size, '], then [', p_size % 7, '] and [', p_size, '] again (Lee, ', 1800 + p_size, ').')"


@query(f"SELECT p_partkey, raw, regexp_extract(raw, '((?:19|20)\\d{{2}})', 1) AS year, regexp_extract(raw, '(\\d+(?:-\\d+)?)', 1) AS page, CASE WHEN bare <> '' THEN bare ELSE raw END AS title, CASE WHEN regexp_matches(raw, '(19|20)\\d{{2}}') THEN 0.5 ELSE 0.35 END::DOUBLE AS confidence FROM (SELECT *, trim(regexp_replace(raw, '\\[\\d+\\]|\\((?:19|20)\\d{{2}}\\)', '', 'g'), ' ,.;') AS bare FROM (SELECT DISTINCT p_partkey, unnest(list_concat(regexp_extract_all(m, '\\([A-Z][A-Za-z]+(?:\\s+et al\\.)?,?\\s*\\d{{4}}\\)'), regexp_extract_all(m, '\\[\\d+\\]'))) AS raw FROM (SELECT p_partkey, {_MENTIONS} AS m FROM part)))")
def e05_mentions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(C.mentions(F.expr(_MENTIONS))).alias("m")).select("p_partkey", "m.*")
    return p.withColumn("year", F.coalesce("year", F.lit("")))


@query("SELECT DISTINCT a.p_partkey AS source, b.p_partkey AS target, greatest(0.55, CASE WHEN a.p_size % 2 = 0 THEN 0.65 ELSE 0.5 END)::DOUBLE AS confidence FROM part a JOIN part b ON lower(a.p_name || ' ' || a.p_brand) = lower(b.p_name || ' ' || b.p_brand) AND a.p_partkey <> b.p_partkey")
def r32_mention_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    docs = p.selectExpr("p_partkey AS id", "concat(p_name, ' ', p_brand) AS title")
    found = p.selectExpr("p_partkey AS id", "upper(concat(p_name, ' ', p_brand)) AS title", "CASE WHEN p_size % 2 = 0 THEN 0.65D ELSE 0.5D END AS confidence")
    return C.mention_edges(docs, found)


_NOTE = """CASE p_partkey % 5
 WHEN 0 THEN concat('山田', p_brand, '编：『', p_name, '史』，東京：', p_type, '社，', 1900 + p_size, '年，第', p_size, '-', p_size + 3, '頁。')
 WHEN 1 THEN concat('参见《', p_name, '》（李氏：『原題', p_brand, '』），北京：出版', p_size, '，', 1950 + p_size, '年，第', p_size, '、', p_size + 2, '页。')
 WHEN 2 THEN concat('JACAR Ref.', p_partkey, '、「', p_name, '」')
 WHEN 3 THEN concat('紀要 ', p_name, ' 第', p_size, '页')
 ELSE concat('「', p_name, '」著、', p_size + 9, '~', p_size, '頁') END"""
_COLON = "'([^\\s、，,。；;:：]{1,20})\\s*[：:]\\s*([^、，,。；;]{1,40})'"
_LISTED, _RANGED, _SINGLE = "'第?\\s*(\\d+(?:\\s*[,，、]\\s*\\d+)+)\\s*[页頁]'", "'第?\\s*(\\d+)\\s*[-—－~～]\\s*(\\d+)\\s*[页頁]'", "'第?\\s*(\\d+)\\s*[页頁]'"
_INNER = ("'[（(][^（）()]{0,100}[：:]\\s*[「『《](.+?)[」』》][^（）()]{0,100}[）)]'", "'[（(]\\s*[「『《](.+?)[」』》]\\s*[）)]'")


@query(f"""WITH t AS (SELECT p_partkey, {_clean(_NOTE)} AS t FROM part),
f AS (SELECT *, {_clean("regexp_extract(t, '[「『《](.+?)[」』》]', 1)")} AS f1, {_clean(f"regexp_extract(t, {_INNER[0]}, 1)")} AS i1, {_clean(f"regexp_extract(t, {_INNER[1]}, 1)")} AS i2 FROM t),
g AS (SELECT *, CASE WHEN i1 <> '' AND i1 <> f1 THEN i1 WHEN i2 <> '' AND i2 <> f1 THEN i2 ELSE f1 END AS title FROM f),
h AS (SELECT *, title <> '' AND instr(t, title) > 0 AS known, trim(substr(t, 1, instr(t, title) - 1), '「『《（( ，,。；;:：') AS au FROM g),
k AS (SELECT *, CASE WHEN known THEN substr(t, instr(t, title) + length(title)) ELSE t END AS after FROM h)
SELECT p_partkey, title, CASE WHEN known THEN {_clean("regexp_replace(au, '(著|编纂|編纂|研究会編|研究會編|编|編)\\s*$', '')")} ELSE '' END AS author, {_clean(f"regexp_extract(after, {_COLON}, 1)")} AS place, {_clean(f"regexp_extract(after, {_COLON}, 2)")} AS publisher, regexp_extract(t, '(1[89]\\d{{2}}|20\\d{{2}})年', 1) AS year,
 CASE WHEN regexp_matches(t, {_LISTED}) THEN regexp_extract(t, {_LISTED}, 0) WHEN regexp_matches(t, {_RANGED}) THEN regexp_extract(t, {_RANGED}, 0) ELSE regexp_extract(t, {_SINGLE}, 0) END AS page_label,
 array_to_string(CASE WHEN regexp_matches(t, {_LISTED}) THEN list_transform(regexp_extract_all(regexp_extract(t, {_LISTED}, 1), '\\d+'), lambda x: x::BIGINT) WHEN regexp_matches(t, {_RANGED}) THEN CASE WHEN regexp_extract(t, {_RANGED}, 1)::BIGINT <= regexp_extract(t, {_RANGED}, 2)::BIGINT THEN generate_series(regexp_extract(t, {_RANGED}, 1)::BIGINT, regexp_extract(t, {_RANGED}, 2)::BIGINT) ELSE [regexp_extract(t, {_RANGED}, 1)::BIGINT, regexp_extract(t, {_RANGED}, 2)::BIGINT] END WHEN regexp_matches(t, {_SINGLE}) THEN [regexp_extract(t, {_SINGLE}, 1)::BIGINT] ELSE [] END, ',') AS pages,
 CASE WHEN contains(lower(t), 'jacar') OR contains(lower(t), 'ref.') THEN 'archive' WHEN regexp_matches(t, '紀要|学报|期') THEN 'article' ELSE 'book' END AS type FROM k""")
def e06_footnotes(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", C.footnote(F.expr(_NOTE)).alias("n")).select("p_partkey", "n.*")
    return n.withColumn("pages", F.array_join("pages", ","))
