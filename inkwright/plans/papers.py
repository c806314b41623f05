"""Queries for page mapping, paper layout, citation units, entries and the vector index. Pages are built from the tables, so SQL says what was built in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import citation_units as C
from ..operators import entries as N
from ..operators import evidence as E
from ..operators import layout as L
from ..operators import narratives as T
from ..operators import page_mapping as P
from ..operators import resolvers as R
from ..operators import vector_index as V
from ..operators.retrieval import batch_top_k
from ..operators.spread import spread
from .files import place
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_MODES = ("AIR", "RAIL", "SHIP", "MAIL", "TRUCK", "FOB", "REG AIR")
_HOW = ("in person", "none", "take back", "collect")
#: Lines of orders with a number of their own, n, and words for their parts and suppliers.
_LINES = f"(SELECT *, l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n, {list(_MODES)}[l_partkey % 7 + 1] AS mode, {list(_HOW)}[l_suppkey % 4 + 1] AS how FROM lineitem)"


def _lines(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    named = lambda names, column: F.get(F.array(*map(F.lit, names)), (F.col(column) % len(names)).cast("int"))
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumns({"book": F.col("l_orderkey"), "n": F.row_number().over(order), "mode": named(_MODES, "l_partkey"), "how": named(_HOW, "l_suppkey")})


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def r03_ivf_all_lists(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = V.search(e.filter("vec_id % 20 = 0"), V.build(e, place(spark, "ivf"), lists=20), 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def r03_ivf_recall(spark, sf_dir):
    """What the index finds of r09's neighbours, with as many lists as a sample of the queries takes for nineteen of twenty."""
    e = table(spark, sf_dir, "embeddings")
    asked, index = e.filter("vec_id % 20 = 0"), V.build(e, place(spark, "ivf"))
    probes = V.probes_for(index, asked, 5)
    out = V.recall(V.search(asked, index, 5, probes), batch_top_k(asked, e, 5))
    return out.withColumns({"probes": F.lit(probes), "lists": F.lit(len(index.centroids))})


#: Orders as books: a page of contents, then a page for each line with its heading.
_LISTED = "book, (n + 1)::INT AS scan, l_quantity::INT AS page"


def _books(spark, sf_dir):
    line = _lines(spark, sf_dir).select("book", (F.col("n") + 1).alias("scan"), F.concat(F.lit("第"), F.col("n").cast("string"), F.lit("章 "), "mode").alias("heading"), F.col("l_quantity").cast("int").alias("page"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("scan", F.concat_ws(" …… ", "heading", F.col("page").cast("string")).alias("t")))), lambda x: x["t"])
    contents = line.groupBy("book").agg(F.array_join(listed, "\n").alias("t")).select("book", F.lit(1).alias("scan"), F.concat(F.lit("目　次\n目次\n"), "t").alias("text"))
    return contents.unionByName(line.select("book", "scan", F.concat("heading", F.lit("\nその本文である")).alias("text")))


@query(f"SELECT book, arg_min(scan, page * 100 + scan) AS anchor_scan, min(page) AS anchor_book, 2 AS pages_per_scan FROM (SELECT {_LISTED} FROM {_LINES}) GROUP BY book")
def e24_contents_mapping(spark, sf_dir):
    return P.contents_anchors(_books(spark, sf_dir)).select("book", "anchor_scan", "anchor_book", "pages_per_scan")


def _numbered(spark, sf_dir):
    """Orders as books whose scans print their page numbers, 2 to 4 a scan; the fourth of six scans or more also has a misread one."""
    line = _lines(spark, sf_dir).select("book", F.col("n").alias("scan"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    per, base = 2 + F.col("book") % 3, 1 + F.col("book") % 40
    first = base + (F.col("scan") - 1) * per
    numbers = F.transform(F.sequence(first, first + per - 1), lambda x: F.concat(F.lit(" - "), x.cast("string"), F.lit(" -\nと本文 12 である")))
    odd = F.when((F.col("scan") == 4) & (F.col("n") >= 6), "\n2900").otherwise("")
    return line.select("book", "scan", F.concat(F.array_join(numbers, "\n"), odd).alias("text"))


@query("SELECT l_orderkey AS book, 1 AS anchor_scan, (1 + l_orderkey % 40)::INT AS anchor_book, (2 + l_orderkey % 3)::INT AS pages_per_scan FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def e24_printed_numbers_mapping(spark, sf_dir):
    m = P.visible_anchors(_numbered(spark, sf_dir))
    return m.select("book", "anchor_scan", F.col("anchor_book").cast("int").alias("anchor_book"), F.col("pages_per_scan").cast("int").alias("pages_per_scan"))


_CHAIN = """
WITH f AS (SELECT l_orderkey AS book, 1 AS s, 1 + l_orderkey % 40 AS b, 2 + l_orderkey % 3 AS p FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3),
x AS (SELECT o.o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'hard' WHEN o_orderkey % 11 = 1 THEN 'soft' END AS bad, o_orderkey % 7 = 0 AS cached, o_custkey % 5 = 0 AND (o_custkey % 2 = 0 OR o_orderkey % 3 = 0) AS named, o_custkey % 5 = 0 AND NOT (o_custkey % 2 = 0 OR o_orderkey % 3 = 0) AS other, f.*, o_orderkey % 60 + 1 AS page FROM orders o LEFT JOIN f ON f.book = o_orderkey),
y AS (SELECT *, CASE WHEN bad = 'hard' THEN 'failed' WHEN cached AND p > 2 THEN 'refined' WHEN cached THEN 'cache' WHEN named THEN 'source_cache' WHEN p IS NOT NULL THEN 'inferred' ELSE 'none' END AS origin FROM x),
z AS (SELECT *, CASE WHEN origin IN ('refined', 'inferred') THEN s WHEN origin = 'cache' THEN 5 WHEN origin = 'source_cache' THEN 3 END AS ms, CASE WHEN origin IN ('refined', 'inferred') THEN b WHEN origin = 'cache' THEN 1 WHEN origin = 'source_cache' THEN 9 END AS mb, CASE WHEN origin IN ('refined', 'inferred') THEN p WHEN origin IN ('cache', 'source_cache') THEN 2 END AS mp FROM y)
SELECT id, origin, COALESCE(ms + greatest(0, (greatest(1, page - 2) - mb) // mp * (CASE WHEN greatest(1, page - 2) >= mb THEN 1 ELSE 0 END)), 0)::INT AS start_scan, COALESCE(ms + (CASE WHEN page + 4 >= mb THEN (page + 4 - mb) // mp ELSE 0 END), 0)::INT AS end_scan, bad IS NOT NULL OR (other AND NOT cached) AS noted FROM z"""


@query(_CHAIN)
def z24_mapping_chain(spark, sf_dir):
    """Orders as citations of books: some failed before, some cached, some cached by customer for one book in three."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("book"), F.col("o_custkey").alias("source_key"), F.expr("array(CAST(o_orderkey % 60 + 1 AS INT), CAST(o_orderkey % 60 + 3 AS INT))").alias("pages"))
    failures = o.filter("book % 11 < 2").select("book", F.expr("CASE WHEN book % 11 = 0 THEN 'DOWNLOAD_HTTP_404 at once' ELSE 'timeout' END").alias("reason"))
    cache = o.filter("book % 7 = 0").select("book", F.lit(5).alias("anchor_scan"), F.lit(1).alias("anchor_book"), F.lit(2).alias("pages_per_scan"))
    inferred = P.visible_anchors(_numbered(spark, sf_dir))
    keyed = o.filter("source_key % 5 = 0").select("source_key").distinct()
    # Half of the sources' mappings are for all their books, the others for a book that only every third order is.
    anyone = keyed.filter("source_key % 2 = 0").select("source_key", F.lit(None).cast("long").alias("book"))
    sources = o.withColumn("source_key", F.expr("CASE WHEN source_key % 5 = 0 AND source_key % 2 <> 0 THEN source_key * 3 + CAST(book % 3 = 0 AS INT) + 1000000000 ELSE source_key END"))
    third = sources.filter("source_key > 1000000000").select("source_key", F.expr("CASE WHEN book % 3 = 0 THEN NULL ELSE -1L END").alias("book")).distinct()
    named = anyone.unionByName(third).withColumns({"anchor_scan": F.lit(3), "anchor_book": F.lit(9), "pages_per_scan": F.lit(0)})
    out = P.mapped_ranges(sources, inferred, cache, named, failures)
    return out.select("id", "origin", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("start_scan", "end_scan")), F.col("note").isNotNull().alias("noted"))


#: Orders as pages: two fragments a line of the body, a head, a number, and a note for each returned line.
_WORDS = "lower(mode) || ' ' || how"


@query(f"WITH t AS (SELECT book AS page, n, {_WORDS} AS t, l_returnflag = 'R' AS r FROM {_LINES}), a AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY page ORDER BY n)::INT - 1 AS upto FROM t) SELECT page, string_agg(t, ' ' ORDER BY n) AS text, array_to_string(list(upto::VARCHAR ORDER BY n) FILTER (WHERE r), ',') AS places, count(*) FILTER (WHERE r) AS notes FROM a GROUP BY page")
def s20_paper_pages(spark, sf_dir):
    line = _lines(spark, sf_dir).withColumns({"page": F.col("book"), "mark": F.expr("CASE WHEN l_returnflag = 'R' THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', n, 1) ELSE '' END"), "y": F.lit(60.0) + 40 * F.col("n")})

    def box(when, x, y, size, text):
        return F.when(when, F.struct(F.lit(1600.0).alias("height"), F.lit(x).alias("x0"), y.alias("y0"), F.lit(x + 100.0).alias("x1"), (y + 10).alias("y1"), F.lit(size).alias("size"), text.alias("text")))

    # The first line of an order also gives its page's head and number.
    every, first, noted = F.lit(True), F.col("n") == 1, F.col("mark") != ""
    boxes = [box(every, 300.0, F.col("y") + 2, 12.0, F.concat("how", "mark")), box(every, 72.0, F.col("y"), 12.0, F.concat(F.lower("mode"), F.lit(" "))), box(first, 72.0, F.lit(20.0), 12.0, F.lit("Running head")), box(first, 400.0, F.lit(1560.0), 12.0, F.col("page").cast("string").substr(1, 4))]
    boxes += [box(noted, 72.0, F.lit(1000.0) + 20 * F.col("n"), 9.0, F.concat("mark", F.lit(" see "), "mode")), box(noted, 72.0, F.lit(1010.0) + 20 * F.col("n"), 9.0, F.lit("and more"))]
    lines = line.select(F.lit(1).alias("doc"), "page", F.explode(F.array_compact(F.array(*boxes))).alias("b")).select("doc", "page", "b.*")
    # Rows are made once and read for the pages and for their notes.
    L.zoned_rows(L.page_rows(lines)).write.parquet(rows := place(spark, "rows"))
    zoned = spark.read.parquet(rows)
    kept = L.page_notes(zoned).groupBy("page").agg(F.count("*").alias("n"))
    pages = L.paper_pages(zoned).join(kept, "page", "left")
    places = F.nullif(F.array_join(F.transform("notes", lambda p: p["position"].cast("string")), ","), F.lit(""))
    return pages.select("page", "text", places.alias("places"), F.coalesce("n", F.lit(0)).cast("long").alias("notes"))


@query("SELECT doc_id, 'A long enough title number ' || doc_id AS title, trim('q' || substr(b, 1, 40)) AS abstract, trim('q' || substr(b, 41, 60)) AS methodology, '' AS results, 1::BIGINT AS n_references FROM (SELECT doc_id, translate(regexp_replace(COALESCE(text, ''), '[^a-z ]+', '', 'g'), ':', '') || repeat('x ', 60) AS b FROM documents)")
def z30_paper_structure(spark, sf_dir):
    b = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]+", ""), F.lit("x " * 60))
    d = table(spark, sf_dir, "documents").select("doc_id", b.alias("b"))
    first = F.concat(F.lit("\narXiv 1234.5678 of the year\nA long enough title number "), F.col("doc_id").cast("string"), F.lit("\nAbstract:\nq"), F.substring("b", 1, 40), F.lit("\n1 Beginning\nmore"))
    second = F.concat(F.lit("2. Method\nq"), F.substring("b", 41, 60), F.lit("\nDiscussion: none\nReferences\n[1] A book with a title that is long enough to count\n"))
    pages = d.select("doc_id", F.lit(1).alias("page"), first.alias("text")).unionByName(d.select("doc_id", F.lit(2).alias("page"), second.alias("text")))
    s = L.paper_structure(pages, "doc_id")
    return s.select("doc_id", "title", "abstract", "methodology", "results", F.size("references").cast("long").alias("n_references"))


@query(f"SELECT book AS paragraph, n::VARCHAR AS note_id, CASE WHEN l_returnflag = 'R' THEN 'item ' || l_partkey || ' by ' || lower(mode) ELSE 'The item ' || l_partkey || ' went by ' || lower(mode) || ' today.' END AS text, CASE WHEN l_returnflag = 'R' THEN 'direct_quote' ELSE 'nearest_sentence' END AS unit_type, CASE WHEN l_returnflag = 'R' THEN 0.95 ELSE 0.82 END::DOUBLE AS confidence FROM {_LINES}")
def c15_citation_units(spark, sf_dir):
    """Orders as paragraphs: a sentence for each line, some quoting, with a marker after each."""
    said = F.expr("CASE WHEN l_returnflag = 'R' THEN concat(' He said: “item ', l_partkey, ' by ', lower(mode), '”') ELSE concat(' The item ', l_partkey, ' went by ', lower(mode), ' today.') END")
    upto = F.sum(F.length("s")).over(Window.partitionBy("book").orderBy("n"))
    line = _lines(spark, sf_dir).select("book", "n", said.alias("s")).withColumn("at", upto)
    ordered = F.array_sort(F.collect_list(F.struct("n", "s", "at")))
    rows = line.groupBy(F.col("book").alias("paragraph")).agg(ordered.alias("l"))
    notes = F.transform("l", lambda x: F.struct(x["n"].cast("string").alias("note_id"), x["at"].cast("int").alias("position")))
    rows = rows.select("paragraph", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("text"), notes.alias("notes"))
    return C.citation_units(rows).select("paragraph", "note_id", "text", "unit_type", "confidence")


#: Orders as entries of a directory: modes of shipment stand for recognised marks, in good and bad forms.
_MARKS = {"AIR": "【出】明治十年", "RAIL": "【本籍】東京", "SHIP": "【玉籍】大阪", "MAIL": "【經】満鉄入社", "TRUCK": "経歴】満鉄退社", "FOB": "趣味】読書"}


@query(f"WITH l AS (SELECT l_orderkey, n, mode AS m, l_discount * 10 AS c, n = 1 AND l_returnflag <> 'N' AS title FROM {_LINES}), g AS (SELECT l_orderkey, bool_or(title) AS named, count(*) FILTER (WHERE NOT title AND m <> 'REG AIR') AS marks, count(*) FILTER (WHERE NOT title AND m = 'AIR') AS a, count(*) FILTER (WHERE NOT title AND m IN ('RAIL', 'SHIP')) AS b, count(*) FILTER (WHERE NOT title AND m = 'MAIL') AS c, count(*) FILTER (WHERE NOT title AND m = 'TRUCK') AS d, round(avg(c) FILTER (WHERE c > 0), 4) AS mean_confidence, COALESCE(round(avg((c < 0.86)::INT) FILTER (WHERE c > 0), 4), 0) AS low_ratio FROM l GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN named THEN '山田太郎' END AS name, marks::INT AS marks, mean_confidence::DOUBLE AS mean_confidence, array_to_string(list_filter([CASE WHEN marks < 2 THEN 'few_field_markers' END, CASE WHEN low_ratio > 0.25 THEN 'many_low_confidence_lines' END, CASE WHEN NOT named THEN 'missing_title_name' END, CASE WHEN a > 1 THEN 'repeated_出生' END, CASE WHEN b > 1 THEN 'repeated_本籍' END, CASE WHEN c > 1 THEN 'repeated_經歴' END, CASE WHEN d > 1 THEN 'repeated_経歴' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g")
def g24_entry_quality(spark, sf_dir):
    first = (F.col("n") == 1) & (F.col("l_returnflag") != "N")
    text = F.lit("満洲国の某")
    for mode, mark in _MARKS.items():
        text = F.when(F.col("mode") == mode, mark).otherwise(text)
    line = _lines(spark, sf_dir).select("l_orderkey", "n", F.when(first, "山田　太郎").otherwise(text).alias("text"), (F.col("l_discount") * 10).alias("confidence"), F.when(first, "タイトル本文").otherwise("本文").alias("kind"))
    rows = line.withColumn("is_title", N.title_line(F.col("text"), F.col("kind"), F.lit(300), F.lit(40)))
    q = N.entry_quality(rows, "l_orderkey", "n", least_chars=0)
    return q.select("l_orderkey", "name", F.col("marks").cast("int").alias("marks"), "mean_confidence", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '【出生】明治' WHEN 1 THEN '【本籍】東京' WHEN 2 THEN '【經歴】入社' WHEN 3 THEN '【家族】妻' WHEN 4 THEN '【住所】大連' ELSE '【續柄】長男' END || ' ' || p_brand AS text FROM part")
def x05_repaired_marks(spark, sf_dir):
    text = F.expr("concat(CASE p_size % 6 WHEN 0 THEN '【生】明治' WHEN 1 THEN '本箱】東京' WHEN 2 THEN '【經歷】入社' WHEN 3 THEN '家族妻' WHEN 4 THEN '住所大連' ELSE '續】長男' END, '  \t ', p_brand, ' \n\n\n')")
    return table(spark, sf_dir, "part").select("p_partkey", N.repaired_marks(text).alias("text"))


@query("SELECT p_partkey, p_size % 8 IN (0, 1, 3, 6) AS title FROM part")
def e25_title_lines(spark, sf_dir):
    """Names, places and offices as lines of several shapes."""
    text = F.expr("CASE p_size % 8 WHEN 0 THEN '山田 太郎' WHEN 1 THEN '市川重三郎' WHEN 2 THEN '満鉄総務部' WHEN 3 THEN '奥村重直' WHEN 4 THEN '三馬路一一七' WHEN 5 THEN '大和通' WHEN 6 THEN '島田一二' ELSE '山田太郎' END")
    kind, height = F.expr("CASE WHEN p_size % 8 IN (3, 7) THEN '本文' ELSE 'タイトル本文' END"), F.expr("CASE WHEN p_size % 8 = 3 THEN 180 ELSE 40 END")
    return table(spark, sf_dir, "part").select("p_partkey", N.title_line(text, kind, F.lit(60), height).alias("title"))


_CLAIM, _OTHER = "维护制度的实践路径与满洲铁道的调查", "A passage in another script that says nothing of it."


@query(f"SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN 42 ELSE 41 END AS page, 0.8::DOUBLE AS score, '{_CLAIM}の記録である' AS matched FROM orders")
def r25_alignment(spark, sf_dir):
    """Orders as candidates: two pages each, of several segments, one of which holds the claim."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    held = F.lit(f"{_OTHER}\n\n短い\n\n{_CLAIM}の記録である\n\n{_OTHER}")
    texts = F.array(F.struct(F.lit(41).alias("page"), F.when(F.col("candidate_id") % 3 == 0, _OTHER).otherwise(held).alias("text")), F.struct(F.lit(42).alias("page"), F.when(F.col("candidate_id") % 3 == 0, held).otherwise(f"{_OTHER}\n\n{_OTHER}").alias("text")))
    found = E.aligned(o.withColumn("claim", F.lit(_CLAIM)), o.select("candidate_id", F.explode(texts).alias("p")).select("candidate_id", "p.page", "p.text"), {})
    # The claim is the beginning of its segment: all its characters and pairs are there; the ratio of sequences depends on the lengths.
    a, b = len(_CLAIM), len(_CLAIM) + len("の記録である")
    return found.select("candidate_id", "page", F.round(F.col("score") - 0.2 * (2 * a / (a + b)) + 0.2, 3).alias("score"), "matched")


@query("SELECT o_orderkey AS candidate_id, CASE o_orderkey % 7 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 10 WHEN 4 THEN 10 WHEN 5 THEN 10 ELSE 12 END AS page, CASE o_orderkey % 7 WHEN 0 THEN 'cited_pages' WHEN 1 THEN 'context_promoted_from_cited_pages' WHEN 2 THEN 'context_fallback' WHEN 3 THEN 'all_extracted_pages' WHEN 4 THEN 'cited_pages' WHEN 5 THEN 'distributed_cited_pages' ELSE 'context_fallback' END AS scope FROM orders")
def r26_page_priority(spark, sf_dir):
    """Orders as candidates of seven kinds: the claim on a cited page, beside one, where no cited page is at hand, and so on."""
    kind = F.col("candidate_id") % 7
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id")).withColumn("claim", F.lit(_CLAIM))
    cited = F.when(kind == 3, F.array().cast("array<int>")).when(kind == 2, F.array(F.lit(90))).when(kind.isin(4, 5), F.array(F.lit(10), F.lit(11))).otherwise(F.array(F.lit(10)))
    mode = F.when(kind == 4, "continuous_range").when(kind == 5, "distributed_pages").otherwise("single_page")
    o = o.withColumns({"cited": cited, "mode": mode, "claims": F.array(F.lit(_CLAIM[:9]), F.lit(_CLAIM[9:]))})
    held, other = F.lit(_CLAIM + "の記録である"), F.lit(_OTHER)
    first = F.when(kind.isin(0, 3, 5), held).when(kind == 6, F.lit("short")).when(kind == 4, F.lit(_CLAIM[:12] + "とある、その前半である")).otherwise(other)
    second = F.when(kind.isin(1), held).when(kind == 4, F.lit(_CLAIM[12:] + "とある、その後半である")).otherwise(other)
    third = F.when(kind.isin(2), held).when(kind == 6, F.lit("満と鉄のみを少し含むが、ほとんど関係のない別の長い文章である。" + _OTHER * 2)).otherwise(other)
    pages = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(10 + k).alias("page"), t.alias("text")) for k, t in enumerate((first, F.when(kind == 6, F.lit("short")).otherwise(second), third))))
    rows = o.select("candidate_id", F.explode(pages).alias("p")).select("candidate_id", "p.ordinal", "p.page", "p.text")
    return E.page_priority_alignment(o, rows, {}).select("candidate_id", "page", "scope")


@query(f"SELECT book, '山田太郎' AS name, '東京' AS hometown, count(*) AS careers, arg_min(1925 + (n * 7) % 19 + 1, [(n * 7) % 19, n]) AS first_year, arg_min('昭和' || ((n * 7) % 19 + 1) || '年 満鉄' || how || '部', [(n * 7) % 19, n]) AS first_unit FROM {_LINES} GROUP BY book")
def e17_person_blocks(spark, sf_dir):
    """Orders as blocks: a name, a birthplace, and a career with a line for each line of the order."""
    year = (F.col("n") * 7) % 19 + 1
    said = F.concat(F.lit("昭和"), year.cast("string"), F.lit("年 満鉄"), "how", F.lit("部 勤務"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"])
    blocks = _lines(spark, sf_dir).groupBy("book").agg(F.array_join(ordered, "\n").alias("s"))
    blocks = blocks.select("book", F.concat(F.lit("山田太郎（やまだ）\n本籍： 東京, 麻布\n短\n"), "s").alias("text"))
    found = T.person_blocks(blocks)
    first = F.get("experiences", F.lit(0))
    return found.select("book", "name", "hometown", F.size("experiences").cast("long").alias("careers"), first["start"]["year"].cast("long").alias("first_year"), first["unit"].alias("first_unit"))


@query(f"SELECT book, n - 1 AS ordinal, '直接引语' AS kind, 'item ' || l_partkey AS text, CASE WHEN n % 2 = 1 THEN 'Yamada' ELSE '' END AS speaker, CASE WHEN n % 2 = 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, 2::BIGINT AS times FROM {_LINES}")
def e16_speeches(spark, sf_dir):
    """Orders as texts with a speech for each line; both patterns of its quotation marks find it."""
    said = F.concat(F.when(F.col("n") % 2 == 1, "\nYamada 曰").otherwise("\nThen "), F.lit("「item "), F.col("l_partkey").cast("string"), F.lit("」。"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"])
    docs = _lines(spark, sf_dir).groupBy("book").agg(F.array_join(ordered, "").alias("text"))
    found = T.speeches(docs, "book")
    rows = found.groupBy("book", "start", "kind", "text", "speaker", "confidence").agg(F.count("*").alias("times"))
    return rows.select("book", (F.row_number().over(Window.partitionBy("book").orderBy("start")) - 1).cast("long").alias("ordinal"), "kind", "text", "speaker", "confidence", "times")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'in 1905' WHEN 2 THEN '1931-12' WHEN 3 THEN '1904年3月5日' ELSE '' END AS date, CASE p_size % 4 WHEN 1 THEN p_brand WHEN 2 THEN substr('1931-12, ' || p_brand, 1, 50) WHEN 3 THEN p_brand ELSE '' END AS event FROM part")
def e10_timeline(spark, sf_dir):
    """The first event of texts with a year in a line, a year alone, a full date, and none."""
    text = F.expr("CASE p_size % 4 WHEN 1 THEN concat('no\\nin 1905年', p_brand) WHEN 2 THEN concat('See 1931-12, ', p_brand) WHEN 3 THEN concat('1904年3月5日：', p_brand) ELSE 'nothing' END")
    found = F.get(T.timeline(F.col("t")), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", F.coalesce(found["date"], F.lit("")).alias("date"), F.coalesce(found["event"], F.lit("")).alias("event"))


_NATION_TERMS = "SELECT n_nationkey AS ord, 'n' || n_regionkey AS source_id, lower(replace(n_name, ' ', '')) AS t FROM nation"


@query(f"WITH i AS (SELECT ord, source_id, unnest([t, substr(t, 1, 4)]) AS t FROM ({_NATION_TERMS})), c AS (SELECT s_suppkey AS id, unnest([lower(replace(n_name, ' ', '')) || 'archive', 'x' || s_suppkey]) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT id, ord, source_id, count(DISTINCT i.t) AS hits FROM c JOIN i ON contains(c.t, i.t) OR contains(i.t, c.t) GROUP BY id, ord, source_id), f AS (SELECT *, row_number() OVER (PARTITION BY id, source_id ORDER BY hits DESC, ord) AS r FROM m) SELECT id, source_id, hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, ord) AS rank FROM f WHERE r = 1")
def z16_configured_ids(spark, sf_dir):
    """Suppliers as citations, nations as configured sources of their region's id."""
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("source_id"), F.array(F.col("n_name"), F.substring(F.replace("n_name", F.lit(" ")), 1, 4)).alias("terms"), F.lit(False).alias("is_default"))
    asked = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.array(F.concat("n_name", F.lit("・Archive")), F.concat(F.lit("X"), F.col("s_suppkey").cast("string"))).alias("terms"))
    return R.configured_ids(asked, items).select("id", "source_id", "hits", F.col("rank").cast("long").alias("rank"))


@query("WITH i AS (SELECT n_nationkey AS ord, n_regionkey, lower(replace(n_name, ' ', '')) AS t FROM nation), c AS (SELECT s_suppkey AS id, lower(replace(n_name, ' ', '')) || 'archive' AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT DISTINCT id, ord, n_regionkey FROM c JOIN i ON contains(c.t, i.t) OR contains(i.t, c.t)) SELECT id, array_to_string(list_sort(list(ord)), ',') AS items, count(DISTINCT n_regionkey) AS sources, 1 + count(DISTINCT n_regionkey) AS anchors FROM m GROUP BY id")
def z17_configured_documents(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("source_id"), F.array("n_name").alias("terms"), F.array(F.lit("all"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("")).alias("anchor"))
    asked = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.array(F.concat("n_name", F.lit(" Archive"))).alias("terms"))
    found = R.configured_documents(asked, items, ["anchor"])
    return found.select("id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("source_ids").cast("long").alias("sources"), F.size("anchor").cast("long").alias("anchors"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'series' WHEN o_orderstatus = 'F' THEN 'diary' WHEN o_orderpriority LIKE '1%' THEN 'monograph' ELSE 'generic' END AS resolver FROM orders")
def m13_resolver_dispatch(spark, sf_dir):
    rules = [("series", F.col("o_totalprice") > 200000), ("diary", F.col("o_orderstatus") == "F"), ("monograph", F.startswith("o_orderpriority", F.lit("1")))]
    return table(spark, sf_dir, "orders").select("o_orderkey", R.first_rule(rules).alias("resolver"))


@query(f"WITH m AS (SELECT book AS id, n - 1 AS ordinal, 'v' || l_partkey AS source_id, l_suppkey % 3 AS t FROM {_LINES}), f AS (SELECT id, source_id, min(ordinal) AS o FROM m WHERE t < 2 OR (source_id IN (SELECT 'v' || p_partkey FROM part WHERE p_partkey % 50 = 0)) GROUP BY id, source_id), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) AS rank, source_id, o + 1 AS match_rank FROM f) SELECT id, rank, source_id, match_rank FROM (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM r WHERE rank <= 8) WHERE k > 1")
def j19_equivalent_sources(spark, sf_dir):
    """Orders as candidates, their lines as matches: two of three carry the title with another volume, the rest another title; parts divisible by 50 are configured."""
    line = _lines(spark, sf_dir)
    title = F.expr("CASE l_suppkey % 3 WHEN 0 THEN '満洲 国史・第三巻' WHEN 1 THEN '満洲国史（下巻）' ELSE '別の書' END")
    matches = line.select(F.col("book").alias("id"), (F.col("n") - 1).alias("ordinal"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("source_id"), title.alias("title"))
    candidates = line.select(F.col("book").alias("id")).distinct().withColumns({"title": F.lit("論文"), "host_title": F.lit("満洲国史 第十二巻")})
    configured = line.filter("l_partkey % 50 = 0").select(F.col("book").alias("id"), F.col("n").alias("ordinal"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("source_id"))
    found = R.equivalent_sources(candidates, matches, configured)
    return found.select("id", F.col("rank").cast("long").alias("rank"), "source_id", F.col("match_rank").cast("long").alias("match_rank"))
