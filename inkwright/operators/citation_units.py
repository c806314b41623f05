"""What a footnote marker in a paragraph vouches for: an attached quotation, the last sentence, a clause or the whole stretch since the marker before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import collapse
from .claims import claims
from .spread import spread

#: Quotation marks, ends of sentences, marks that a context does not begin with.
QUOTES = (r"“([^”]{2,})”", r"「([^」]{2,})」", r"『([^』]{2,})』", r"\"([^\"\n]{2,})\"")
CLOSING = "[”」』\"]$"
_ENDS, _EDGE = "。！？.!?", "^[，,。；;：:、 ]+"
_SPACE = " \t\n\v\f\r　"


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("quote", StringType())]))


@F.pandas_udf(_SPANS)
def quote_spans(texts: pd.Series) -> pd.Series:
    """Places of quotations of all forms, by their ends; built-ins give matches without their places."""
    out = []
    for text in texts:
        found = [(m.start(), m.end(), " ".join(m.group(1).split())) for p in QUOTES for m in re.finditer(p, text or "")]
        out.append([{"start": a, "stop": b, "quote": q} for a, b, q in sorted(found, key=lambda x: (x[1], x[0]))])
    return pd.Series(out)


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def trimmed(text: Column, limit: int = 280) -> Column:
    """The last `limit` characters of the cleaned text, not beginning with a mark."""
    cleaned = F.regexp_replace(collapse(text), _EDGE, "")
    return F.when(F.length(cleaned) <= limit, cleaned).otherwise(F.regexp_replace(F.right(cleaned, F.lit(limit)), _EDGE, ""))


def last_sentence(text: Column) -> Column:
    """From the last end of a sentence, not counting the marks at the very end."""
    whole = _stripped(text)
    core = F.rtrim(whole, F.lit(_ENDS))
    kept = F.length(F.element_at(F.split(core, f"[{_ENDS}]"), -1)) + F.length(whole) - F.length(core)
    return F.right(whole, kept)


def citation_units(paragraphs: DataFrame, key: str = "paragraph") -> DataFrame:
    """(key, note_id, text, unit_type, confidence, claims, following) of every marker of paragraphs (key, text, notes: (note_id, position)).

    A marker vouches for text since the marker before it. A quotation that ends within three characters before the marker comes first; then the last
    sentence of 12 characters or more, else the stretch; of long stretches (over 180 characters) the last fitting claim. `following` is
    what stands between this marker and the sentence of the next one, without a note of its own. Null texts are empty; a paragraph without markers gives nothing.
    """
    order = Window.partitionBy("_p").orderBy("position", "note_id")
    rows = paragraphs.withColumn("_p", F.monotonically_increasing_id()).select("_p", key, F.coalesce("text", F.lit("")).alias("_text"), "notes")
    rows = spread(rows, "_p").withColumn("_quotes", quote_spans("_text")).select("_p", key, "_text", "_quotes", F.explode("notes").alias("_n")).select("_p", key, "_text", "_quotes", F.col("_n.note_id").alias("note_id"), F.col("_n.position").cast("int").alias("position"))
    rows = rows.withColumns({"_from": F.coalesce(F.lag("position").over(order), F.lit(0)), "_next": F.lead("position").over(order)})
    cut = lambda a, b: F.substring(F.col("_text"), a + 1, F.greatest(b - a, F.lit(0)))
    at = F.col("position")
    bounded = cut(F.col("_from"), at)
    after = F.when(F.col("_next").isNotNull(), _stripped(cut(at, F.col("_next")))).otherwise("")
    tail = last_sentence(after)
    following = trimmed(F.substring(after, F.lit(1), F.length(after) - F.length(tail)), 360)
    near = F.filter("_quotes", lambda q: (q["start"] >= F.col("_from")) & (q["stop"] <= at) & (at - q["stop"] <= 3))
    attached = F.right(F.rtrim(F.substring(F.col("_text"), F.lit(1), at), F.lit(_SPACE)), F.lit(2)).rlike(CLOSING)
    rows = rows.withColumns({"following": following, "_quote": F.when(attached, F.try_element_at(near, F.lit(-1))["quote"]), "_bounded": bounded})
    sentence = last_sentence(F.col("_bounded"))
    rows = rows.withColumn("_context", trimmed(F.when(F.length(collapse(sentence)) >= 12, sentence).otherwise(F.col("_bounded")), 520))
    rows = rows.withColumn("_claims", claims(F.col("_context")))
    text, found = F.col("_context"), F.col("_claims")
    last = F.try_element_at(found, F.lit(-1))
    fitting = F.try_element_at(F.filter(found, lambda c: F.length(c).between(12, 160)), F.lit(-1))
    some = F.size(found) > 0

    def unit(name: str, value: Column, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("unit_type"), trimmed(value).alias("text"), F.lit(confidence).alias("confidence"))

    chosen = (
        F.when(text == "", unit("empty", F.lit(""), 0.0))
        .when((F.length(text) < 12) & some, unit("nearest_sentence_expanded", last, 0.62))
        .when((F.length(text) > 180) & some, unit("previous_clause", F.coalesce(fitting, last), 0.58))
        .when(F.array_contains(found, text), unit("nearest_sentence", text, 0.82))
        .otherwise(unit("paragraph_span", text, 0.48))
    )
    quote = F.struct(F.lit("direct_quote").alias("unit_type"), F.col("_quote").alias("text"), F.lit(0.95).alias("confidence"))
    rows = rows.withColumn("_u", F.when(F.col("_quote").isNotNull(), quote).otherwise(chosen))
    listed = F.when(F.col("_quote").isNotNull(), F.array("_quote")).otherwise(F.slice("_claims", 1, 8))
    return rows.select(key, "note_id", "_u.text", "_u.unit_type", "_u.confidence", listed.alias("claims"), "following")
