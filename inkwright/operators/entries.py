"""Entries of biographical directories: repair of field marks, title lines, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences

#: Replacements in recognised field marks, then patterns, then replacements again, each in this order.
MARK_FIXES = [("【生】", "【出生】"), ("【出】", "【出生】"), ("【玉籍】", "【本籍】"), ("玉籍", "本籍"), ("【本箱】", "【本籍】"), ("本箱", "本籍"), ("【住尻", "【住所】"), ("【住所", "【住所】"), ("住所】", "【住所】"), ("【經】", "【經歴】"), ("【経】", "【経歴】"), ("【經歴", "【經歴】"), ("【経歴", "【経歴】"), ("經歴】", "【經歴】"), ("経歴】", "【経歴】"), ("【學】", "【學歴】"), ("【学】", "【学歴】"), ("【學歴", "【學歴】"), ("【学歴", "【学歴】"), ("學歴】", "【學歴】"), ("学歴】", "【学歴】"), ("【趣】", "【趣味】"), ("趣味】", "【趣味】"), ("宗教】", "【宗教】"), ("家族】", "【家族】")]
MARK_PATTERNS = [("(?<!【)(出生|本籍|續柄|続柄|續|學歴|学歴|經歴|経歴|經歷|住所|家族|宗教|趣味)】", "【$1】"), ("(?<!【)(住所)(?=[一-龥])", "【住所】"), ("(?<!【)(家族)(?=[妻父母長男長女子])", "【家族】"), ("【(住所|家族|宗教|趣味|經歴|経歴|學歴|学歴)(?!】)", "【$1】"), (r"【+([^【】\n]{1,8})】+", "【$1】")]
LAST_FIXES = [("【出【生】", "【出生】"), ("【經歷】", "【經歴】"), ("【續】", "【續柄】"), ("【生生", "【出生】")]
#: Field marks, those that an entry has once, and the tests of a name.
FIELD_MARKS = ("【出生】", "【生】", "【本籍】", "【續柄】", "【続柄】", "【學歴】", "【学歴】", "【經歴】", "【経歴】", "【趣味】", "【宗教】", "【家族】", "【住所】")
SINGLE_MARKS = ("出生", "本籍", "經歴", "経歴")
NAME = "^[一-龥々〆ヵヶ]{2,6}$"
ADDRESS = "路|街|町|村|區|区|市|縣|県|郡|號|号|番|丁目|胡同|通|電|ノ"
ADDRESS_OF_TITLES = "路|街|町|區|区|縣|県|郡|號|号|番|丁目|胡同|通|電|ノ"
NO_PERSON = "(?:局|部|課|係|處|処|署|廳|庁|府|省|縣|県|市|町|村|社|會|会|銀行|醫院|医院|學院|学院|學校|学校|公會|公会|組合|協會|协会|會社|会社)$"
NUMERALS = "一二三四五六七八九十〇零"


def repaired_marks(text: Column) -> Column:
    """Field marks in one form; runs of spaces and of blank lines are shortened."""
    plain = lambda t, fix: F.replace(t, F.lit(fix[0]), F.lit(fix[1]))
    text = reduce(plain, MARK_FIXES, text)
    text = reduce(lambda t, fix: F.regexp_replace(t, *fix), MARK_PATTERNS, text)
    text = reduce(plain, LAST_FIXES, text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^[\s　]+|[\s　]+$", "")


def person_name(text: Column, of_title: bool = False) -> Column:
    """Two to six Han characters that are no address; of two numerals or more, only a last run of one or two is a name's."""
    text = F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")
    numerals = F.regexp_count(text, F.lit(f"[{NUMERALS}]"))
    counted = (numerals < 2) | text.rlike("[一二三四五六七八九]郎$") | text.rlike(f"^[^{NUMERALS}]+[{NUMERALS}]{{1,2}}$")
    return text.rlike(NAME) & ~text.rlike(ADDRESS_OF_TITLES if of_title else ADDRESS) & counted


def title_line(text: Column, kind: Column, width: Column, height: Column) -> Column:
    """Whether a line is an entry's title: marked as one, or tall and narrow as vertical titles are, and a person's name."""
    compact = F.regexp_replace(text, r"[\s　]+", "")
    marked = F.contains(kind, F.lit("タイトル")) | ((height >= 150) & (width <= 70))
    return F.coalesce(marked & ~compact.rlike(NO_PERSON) & person_name(compact, True), F.lit(False))


def entry_quality(lines: DataFrame, key: str, order: str, least_chars: int = 80) -> DataFrame:
    """(key, name, text, chars, marks, mean_confidence, low_ratio, reasons) of entries from their lines (key, order, text, confidence, is_title).

    Confidences of 0 or null are unknown; without any the mean is null. An entry with a reason needs review.
    """
    known = F.when(F.col("confidence") > 0, F.col("confidence").cast("double"))
    held = F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_title", F.lit(False)).alias("is_title"))))
    rows = lines.groupBy(key).agg(held.alias("_l"), F.round(F.avg(known), 4).alias("mean_confidence"), F.coalesce(F.round(F.avg((known < 0.86).cast("double")), 4), F.lit(0.0)).alias("low_ratio"))
    raw = F.array_join(F.transform(F.filter("_l", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    name = F.regexp_replace(F.get(F.filter("_l", lambda x: x["is_title"]), F.lit(0))["text"], r"[\s　]+", "")
    rows = rows.withColumns({"name": name, "text": repaired_marks(raw)}).drop("_l")
    marks = sum((occurrences(F.col("text"), F.lit(m)) for m in FIELD_MARKS), F.lit(0))
    rows = rows.withColumns({"chars": F.length("text"), "marks": marks})
    repeated = [F.when(occurrences(F.col("text"), F.lit(f"【{m}】")) > 1, f"repeated_{m}") for m in SINGLE_MARKS]
    reasons = F.array_compact(F.array(F.when(F.col("chars") < least_chars, "short_entry"), F.when(F.col("marks") < 2, "few_field_markers"), F.when(F.col("low_ratio") > 0.25, "many_low_confidence_lines"), F.when(F.coalesce("name", F.lit("")) == "", "missing_title_name"), *repeated))
    return rows.select(key, "name", "text", "chars", "marks", "mean_confidence", "low_ratio", reasons.alias("reasons"))
