"""Secret scans: candidates by pattern, false positives removed by a random forest. No Python on executors.

A candidate is one of

* a private key between its BEGIN and END lines;
* a token of three dotted parts that begins as encoded JSON does;
* the password of an address with user and host;
* a token of 16 characters or more after the word Bearer;
* any value of four characters or more after a key-like word and an assignment, whatever its characters;
* a run of at least 16 letters, digits and + / _ - that holds a digit or an inner change from lower to upper case.

Shorter values without any such sign of their own, or in their words before, are no candidates.

Texts are split at candidates, so each one has its exact place and its neighbours. The forest (MLlib) sees

* length and shares of kinds of characters;
* character transitions: changes between vowels, consonants, digits and marks, and upper/lower;
* dictionary coverage: the share of the candidate that common words of names and code, and the most frequent words of the corpus, cover;
* path: whether the source looks like tests, examples or documentation;
* neighbouring words: key-like or digest-like words, assignment and quotes before it.

It learns from labelled findings. Those may be given as a table (value, before, after, path, label);
`labelled_findings` makes a fixed set of LABELLED rows from seeded hashes: keys, tokens and passwords in
the places where they leak, and what scanners confuse with them (digests, ids, card numbers, names, placeholders).
To these come findings of the corpus itself: `plain_findings` are candidates with no form of a known key and no key-like word before them, at most
NEGATIVES, taken by hash. The word list comes from counts over the whole corpus.

`redacted` replaces findings at their places in their own row, so equal values that are no secret elsewhere stay, and rows
need no key. Rows without a candidate do not move.

Null or empty text has no candidate. Findings of rows with a null doc_id are returned with it. Repeated rows
and repeated secrets are findings of their own. Empty tables give empty results. A labelled table without rows of both kinds is
not enough to learn from: the made findings come to it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}={0,2}"
_WORD = r"(?:key|token|secret|password|passwd|pwd|pass|passphrase|credential|credentials)"
#: A key-like word, an assignment and perhaps a quotation mark; lengths are bounded, as they stand in a look-behind.
_ASSIGNED = rf"(?i:{_WORD}[\"']?\s{{0,3}}(?:=|:|=>|:=)\s{{0,3}}[\"']?)"
_VALUE = r"[^\s\"'<>,;]"
_DOTTED = r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]+"
_PRIVATE = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{1,20000}-----END [A-Z ]{0,20}PRIVATE KEY-----"
_USER, _BEARER, _TOKEN = r"://[^\s:/@]{1,64}:", r"(?i:bearer)\s{1,3}", r"[A-Za-z0-9._~+/-]{16,}={0,2}"
CANDIDATE = rf"{_PRIVATE}|{_DOTTED}|(?<=:)(?<={_USER})[^\s@/]{{3,}}(?=@)|(?<=\s)(?<={_BEARER}){_TOKEN}|(?<=[=:>\s\"'])(?<={_ASSIGNED}){_VALUE}{{4,}}|{_RUN}"
#: What a text with a candidate holds; cheaper than the candidates themselves, and true of every text that has one.
_LIKELY = rf"{_PRIVATE}|{_DOTTED}|{_USER}[^\s@/]{{3,}}@|{_BEARER}{_TOKEN}|{_ASSIGNED}{_VALUE}|{_RUN}"
#: Characters before and after a candidate that are looked at for neighbouring words.
NEAR = 80
LABELLED, TREES, DEPTH, THRESHOLD = 6_000, 40, 8, 0.5
#: Findings of the corpus that are learned as no secrets, and words of the corpus that count as a dictionary.
NEGATIVES, WORDS = 2_000, 300
PLACEHOLDER = "<SECRET>"
#: Kinds of made findings.
KINDS = 21

#: Fixed word lists of the features.
DICTIONARY = ("access", "account", "admin", "application", "build", "class", "client", "code", "component", "config", "connection", "controller", "count", "create", "data", "date", "default", "document", "error", "event", "example", "factory", "file", "function", "handler", "html", "http", "image", "index", "info", "item", "label", "list", "local", "manager", "message", "model", "module", "name", "node", "number", "object", "option", "order", "page", "param", "path", "product", "project", "query", "report", "request", "response", "result", "sample", "server", "service", "session", "setting", "source", "state", "status", "string", "system", "table", "test", "text", "time", "title", "type", "update", "user", "value", "version", "view", "widget")
#: Forms of known keys, and words near which a value may be one.
KNOWN_KEY = r"^(?:AKIA|ASIA|gh[pousr]_|eyJ|xox|sk-|-----BEGIN)"
KEY_NEAR = r"(?i)key|token|secret|pass|pwd|bearer|auth|credential|://[^\s:/@]{1,64}:$"
KEY_WORDS = r"(?i)(key|token|secret|pass(w(or)?d|phrase)?|pwd|bearer|auth|credential|apikey)[^A-Za-z]*$"
DIGEST_WORDS = r"(?i)(sha\d*|md5|commit|digest|checksum|hash|etag|uuid|guid|revision|card|order|invoice|isbn|phone|id)[^A-Za-z]*$"
TEST_PATH = r"(?i)(test|example|sample|fixture|doc|readme|mock)"

FEATURES = ("length", "digits", "upper", "lower", "marks", "changes", "case_changes", "vowel_changes", "distinct", "hexadecimal", "only_digits", "covered", "test_path", "key_before", "digest_before", "assigned", "quoted", "near_digits", "in_address", "known_form")


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")) / F.greatest(F.length(value), F.lit(1))


def _changes(value: Column, kinds: list[tuple[str, str]]) -> Column:
    """Changes between kinds of characters, as a share of the length."""
    for pattern, letter in kinds:
        value = F.regexp_replace(value, pattern, letter)
    return (F.length(F.regexp_replace(value, r"(.)\1+", "$1")) - 1) / F.greatest(F.length(value), F.lit(1))


def described(findings: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Findings (value, before, after, path) with the columns FEATURES; `words` are a dictionary besides the fixed one."""
    known = sorted({*DICTIONARY, *(words or ())}, key=lambda w: (-len(w), w))
    v, low = F.col("value"), F.lower("value")
    columns = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "0-9"),
        "upper": _share(v, "A-Z"),
        "lower": _share(v, "a-z"),
        "marks": 1 - _share(v, "A-Za-z0-9"),
        "changes": _changes(v, [("[A-Za-z]", "a"), ("[0-9]", "0"), ("[^a0]", "-")]),
        "case_changes": _changes(v, [("[a-z]", "a"), ("[A-Z]", "B"), ("[^aB]", "-")]),
        "vowel_changes": _changes(low, [("[aeiouy]", "."), ("[a-z]", "b"), ("[0-9]", "0"), ("[^.b0]", "-")]),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "hexadecimal": low.rlike("^[0-9a-f]+$").cast("double"),
        "only_digits": v.rlike("^[0-9]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(known), "")) / F.length(v),
        "test_path": F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATH).cast("double"),
        "key_before": F.col("before").rlike(KEY_WORDS).cast("double"),
        "digest_before": F.col("before").rlike(DIGEST_WORDS).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "near_digits": _share(F.concat(F.substring(F.col("before"), -20, 20), F.substring("after", 1, 20)), "0-9"),
        "in_address": F.col("before").rlike(r"://[^\s:/@]{1,64}:$") & F.col("after").rlike("^@"),
        "known_form": v.rlike(KNOWN_KEY),
    }
    return findings.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


_ROW = "__scanned_row"


def _likely_rows(docs: DataFrame) -> DataFrame:
    """Rows that may hold a candidate, numbered and written, so that a task that runs again sees the same numbers."""
    return written(docs.filter(F.col("text").rlike(_LIKELY)).withColumn(_ROW, F.monotonically_increasing_id()), "likely")


def candidates(rows: DataFrame, path: str = "source") -> DataFrame:
    """_ROW, finding (from 0), start, value, before, after, path of every candidate of numbered rows; places in code points."""
    where = F.col(path).cast("string") if path in rows.columns else F.lit(None).cast("string")
    parts, values = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), 0)
    around = F.transform(parts, lambda p: F.struct(F.length(p).alias("size"), F.substring(p, 1, NEAR).alias("head"), F.right(p, F.lit(NEAR)).alias("tail")))
    cut = rows.select(_ROW, where.alias("path"), around.alias("around"), values.alias("values"))
    zipped = F.arrays_zip(F.col("values"), F.slice("around", F.lit(1), F.size("values")).alias("left"), F.slice("around", F.lit(2), F.size("values")).alias("right"))
    each = cut.select(_ROW, "path", F.posexplode(zipped).alias("finding", "f"))
    each = each.select(_ROW, "path", "finding", F.col("f.values").alias("value"), F.col("f.left").alias("left"), F.col("f.right").alias("right"))
    upto = Window.partitionBy(_ROW).orderBy("finding").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("left.size") + F.length("value")).over(upto) - F.length("value")
    return each.select(_ROW, "finding", start.cast("long").alias("start"), "value", F.col("left.tail").alias("before"), F.col("right.head").alias("after"), "path")


def frequent_words(texts: DataFrame, most: int = WORDS) -> list[str]:
    """The most frequent words of 5 to 12 letters, counted over all texts; ties by the word."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])([a-z]{5,12})(?![a-z])"), 1)).alias("word"))
    rows = found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()
    return [r["word"] for r in rows]


def plain_findings(rows: DataFrame, path: str = "source", most: int = NEGATIVES) -> DataFrame:
    """(value, before, after, path, label): candidates of numbered rows that have neither the form of a known key nor a key-like word before them."""
    found = candidates(rows, path).filter(~F.col("value").rlike(KNOWN_KEY) & ~F.col("before").rlike(KEY_NEAR))
    return found.orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(most).select("value", "before", "after", "path", F.lit(0).alias("label"))


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: int = 11) -> DataFrame:
    """(kind, value, before, after, path, label): a fixed set of findings with known verdicts."""

    def pick(name: str, choices: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, choices)), F.pmod(F.xxhash64("id", F.lit(f"{seed}{name}")), F.lit(len(choices))).cast("int"))

    def digest(name: str) -> Column:
        return F.sha2(F.concat_ws("/", "id", F.lit(f"{seed}{name}")), 512)

    base64 = F.translate(F.base64(F.unhex(digest("b"))), "\n", "")
    number = F.regexp_replace(F.translate(digest("n"), "abcdef", "123456"), "[^0-9]", "")
    capital = F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    words = F.concat_ws("", F.initcap(pick("w1", DICTIONARY)), F.initcap(pick("w2", DICTIONARY)), F.initcap(pick("w3", DICTIONARY)), F.initcap(pick("w4", DICTIONARY)))
    snake = F.concat_ws("_", pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), F.substring(number, 1, 3))
    leak = pick("leak", ('token = "', "password=", "password: ", 'secret = "', "api_key=", 'key: "', "Authorization: Bearer ", "aws_access_key_id = ", "TOKEN = \"", "Password is "))
    plain = pick("plain", ("the ", "see ", "in ", "value ", "for ", "of ", "with ", "a "))
    other = pick("other", ("commit ", "sha256:", "md5 ", "checksum = ", "card ", "order ", "id: ", "etag \"", "uuid=", "phone ", "invoice "))
    after = pick("after", ('"', "\n", " and", ", ", " the", ";"))
    host = F.concat(F.lit("@"), pick("w6", DICTIONARY), F.lit(".example.com"))
    kind = F.pmod(F.xxhash64("id", F.lit(f"{seed}kind")), F.lit(KINDS))
    marks = pick("marks", ("!", "&", "#9", "$x", "%", "@", "*", "-", "."))
    blank = pick("blank", ("your_token_here", "changeme", "example", "${PASSWORD}", "none", "null", "true", "required", "optional", "process.env.KEY", "getpass()", "xxxxxxxx", "****", "string", "the"))
    made = [  # kind, value, before, label
        (0, F.substring(digest("x"), 1, 40), leak, 1),
        (1, F.substring(digest("x"), 1, 18), leak, 1),
        (2, F.substring(base64, 1, 32), leak, 1),
        (3, F.concat(F.lit("AKIA"), F.substring(capital, 1, 16)), F.when(F.col("id") % 2 == 0, leak).otherwise(plain), 1),
        (4, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 36)), F.when(F.col("id") % 2 == 0, leak).otherwise(plain), 1),
        (5, F.upper(F.substring(digest("x"), 1, 40)), leak, 1),
        (6, F.substring(base64, 1, 44), leak, 1),
        (7, F.substring(digest("x"), 1, 40), other, 0),
        (8, F.concat(F.lit("4"), F.substring(number, 1, 15)), F.when(F.col("id") % 2 == 0, other).otherwise(plain), 0),
        (9, words, plain, 0),
        (10, snake, plain, 0),
        (11, F.regexp_replace(F.substring(digest("x"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.when(F.col("id") % 2 == 0, other).otherwise(plain), 0),
        (12, F.concat_ws("/", pick("w1", DICTIONARY), pick("w2", DICTIONARY), F.concat(pick("w3", DICTIONARY), F.substring(number, 1, 2))), plain, 0),
        (13, F.concat(words, F.substring(number, 1, 4)), plain, 0),
        (14, F.concat(F.initcap(pick("w1", DICTIONARY)), F.substring(number, 1, 2), marks, F.substring(base64, 1, 4)), leak, 1),
        (15, F.concat(pick("w1", DICTIONARY), F.substring(number, 1, 3)), leak, 1),
        (16, F.concat(F.lit("eyJ"), F.substring(base64, 1, 24), F.lit("."), F.substring(base64, 24, 30), F.lit("."), F.substring(base64, 40, 30)), F.when(F.col("id") % 2 == 0, leak).otherwise(plain), 1),
        (17, blank, leak, 0),
        (18, F.substring(F.regexp_replace(F.lower(base64), "[^a-z]", ""), 1, 32), F.lit("Authorization: Bearer "), 1),
        (19, F.concat(pick("w1", DICTIONARY), F.substring(number, 1, 2), pick("w2", DICTIONARY)), F.concat(F.lit("postgres://"), pick("w4", DICTIONARY), F.lit(":")), 1),
        (20, F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), base64, F.lit("\n-----END PRIVATE KEY-----")), plain, 1),
    ]
    value, before, label = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, v, b, y in made:
        value, before, label = F.when(kind == k, v).otherwise(value), F.when(kind == k, b).otherwise(before), F.when(kind == k, y).otherwise(label)
    path = pick("path", ("src/main.py", "src7", "test/example.py", "docs/readme.md", "web", "config/app.env"))
    return spark.range(0, rows, 1, 1).select(kind.cast("int").alias("kind"), value.alias("value"), F.concat(plain, pick("w5", DICTIONARY), F.lit(" "), before).alias("before"), F.when(kind == 19, host).otherwise(after).alias("after"), path.alias("path"), label.alias("label"))


def trained(labelled: DataFrame, limit: int = LABELLED + NEGATIVES, seed: int = 5, words: list[str] | None = None) -> PipelineModel:
    """A forest from at most `limit` labelled findings (the smallest by hash), in one partition so that it is reproducible.

    Rows without a value or a label are not used; without rows of both kinds ValueError.
    """
    usable = labelled.filter(F.col("value").isNotNull() & F.col("label").isNotNull()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})
    rows = described(usable.orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(limit), words).select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(1)
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both kinds are needed")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def _scored(docs: DataFrame, rows: DataFrame, labelled: DataFrame | None, path: str) -> DataFrame:
    words = frequent_words(docs.select("text"))
    made = labelled_findings(rows.sparkSession).select("value", "before", "after", "path", "label")
    if labelled is None:
        known = made.unionByName(plain_findings(rows, path))
    else:
        known = labelled.select("value", "before", "after", "path", F.col("label").cast("int").alias("label")).filter("value IS NOT NULL AND label IS NOT NULL")
        known = known if known.select("label").distinct().count() > 1 else known.unionByName(made)
    forest = trained(written(known, "labelled"), words=words)
    scored = forest.transform(described(candidates(rows, path), words))
    score = vector_to_array("probability")[1]
    return scored.select(_ROW, "finding", "start", F.length("value").cast("long").alias("length"), "value", F.round(score, 6).alias("score"), (score >= THRESHOLD).alias("is_secret"))


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, finding, start, length, value, score and is_secret of every candidate."""
    rows = _likely_rows(docs.select("doc_id", "text", *([path] if path in docs.columns else [])))
    return _scored(docs, rows, labelled, path).join(rows.select(_ROW, "doc_id"), _ROW).select("doc_id", "finding", "start", "length", "value", "score", "is_secret")


def redacted(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """`docs` with every secret replaced by PLACEHOLDER and n_chars brought up to date; no row goes."""
    rows = _likely_rows(docs)
    flags = _scored(docs, rows, labelled, path).groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("finding", "is_secret"))).alias("__flags")).filter(F.exists("__flags", lambda f: f["is_secret"]))
    parts, values = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), 0)
    kept = F.zip_with(values, "__flags", lambda v, f: F.when(f["is_secret"], PLACEHOLDER).otherwise(v))
    text = F.array_join(F.zip_with(parts, kept, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    hit = F.col("__flags").isNotNull()
    changed = rows.join(flags, _ROW, "left").withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return docs.filter(~F.coalesce(F.col("text").rlike(_LIKELY), F.lit(False))).unionByName(changed.select(*docs.columns))
