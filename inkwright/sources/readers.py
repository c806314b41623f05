"""Scans: text, Markdown and HTML files, OCR results, dictionaries, download indexes, catalogue records.

All of them are Spark readers with expressions on top, so files are listed, read and split by Spark wherever they
are. Formats without a reader (PDF, DOCX, remote catalogues) have a seam: `external`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_type, strip_html
from ..operators.batches import small_batches

#: Suffixes that a directory scan takes by default.
SUFFIXES = ("pdf", "md", "txt", "markdown", "html", "htm")
SCHEMA = "path string, name string, size long, modified timestamp, kind string, text string, error string"


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = True) -> DataFrame:
    """path, name, size, modified, kind, content (bytes) of every file with one of the suffixes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    kind = file_type(F.col("path"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return rows.filter(suffix.isin(*suffixes)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), kind.alias("kind"), "content")


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = True) -> DataFrame:
    """Text of every file. Bytes that aren't UTF-8 are read by detection; kinds without a reader have an error instead of a text."""

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            for name in ("shift_jis", "gb18030"):
                try:
                    return raw.decode(name)
                except UnicodeDecodeError:
                    continue
            return raw.decode("utf-8", "ignore")

        return contents.map(one)

    rows = files(spark, path, suffixes, recursive)
    known = F.col("kind").isin("text", "markdown", "html")
    text = F.when(F.col("kind") == "html", strip_html(F.col("raw"))).when(known, F.col("raw"))
    # Spark itself reads what is UTF-8, but for its mark; only other files go to Python, a few at a time.
    small_batches(spark)
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    rows = rows.withColumn("_plain", plain).withColumn("_other", decoded(F.when(F.col("_plain").isNull(), F.col("content"))))
    rows = rows.withColumn("raw", F.coalesce(F.when(F.startswith("_plain", F.lit("\ufeff")), F.substring("_plain", 2, 1 << 30)).otherwise(F.col("_plain")), "_other"))
    return rows.select("path", "name", "size", "modified", "kind", text.alias("text"), F.when(~known, F.concat(F.lit("no reader for "), F.col("kind"))).alias("error"))


def ocr_xml(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, x, y, width, height, text, confidence) of an OCR layout file's TEXTBLOCK and LINE elements, in order."""
    schema = "_ID string, LINE array<struct<_ORDER:int,_X:double,_Y:double,_WIDTH:double,_HEIGHT:double,_STRING:string,_CONF:double>>"
    blocks = spark.read.format("xml").option("rowTag", "TEXTBLOCK").schema(schema).load(path)
    lines = blocks.select(F.col("_ID").alias("block"), F.explode("LINE").alias("l"))
    return lines.select("block", F.col("l._ORDER").alias("line"), F.col("l._X").alias("x"), F.col("l._Y").alias("y"), F.col("l._WIDTH").alias("width"), F.col("l._HEIGHT").alias("height"), F.col("l._STRING").alias("text"), F.col("l._CONF").alias("confidence"))


def ocr_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(page, text) of OCR results kept as json, csv or text; a text file holds one page per form feed."""
    if kind == "json":
        return spark.read.schema("page int, text string").option("multiLine", True).json(path)
    if kind == "csv":
        return spark.read.schema("page int, text string").option("header", True).option("multiLine", True).csv(path)
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    raise ValueError(f"no such kind: {kind}")


def entity_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(category, description, entity) of a dictionary file: categories with a description and entities."""
    raw = spark.read.schema("categories map<string,struct<description:string,entities:array<string>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("categories").alias("category", "c"))
    return rows.select("category", F.col("c.description").alias("description"), F.explode("c.entities").alias("entity"))


def download_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, c_start, c_stop, path) of files named ndl_<id>_p<a>-p<b>.pdf."""
    pattern = r"ndl_(\d+)_p(\d+)-p(\d+)\.pdf$"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").filter(F.col("path").rlike(pattern))
    part = lambda k: F.regexp_extract("path", pattern, k)
    return rows.select(part(1).alias("id"), part(2).cast("int").alias("c_start"), part(3).cast("int").alias("c_stop"), "path")


def catalogue_records(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """(title, creator, date, publisher, identifier) of catalogue answers: XML records with plain element names."""
    names = ("title", "creator", "date", "publisher", "identifier")
    schema = "record array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    parsed = rows.select(F.from_xml(xml, schema).alias("r")).select(F.posexplode("r.record").alias("rank", "record"))
    return parsed.select((F.col("rank") + 1).alias("rank"), *[F.col(f"record.{n}").alias(n) for n in names])


def external(rows: DataFrame, call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Seam for readers, models and services outside Spark: `call` gets Arrow batches of rows and gives batches of `schema`."""
    return rows.mapInPandas(call, schema)
