"""DuckDB SQL of the queries that SQL can say whole. It compares everything with everything, so it is for small tables."""

from __future__ import annotations


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>')"


def chat_formatting(marks: str) -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{marks}' UNION ALL SELECT -7, 1, 'assistant', '{marks}')),
f AS (SELECT *, '### ' || replace({_escaped('role')}, ':', '\\:') || ':' || chr(10) || {_escaped('text')} || chr(10) || '</turn>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


#: Every pair of documents that share a shingle, then reachability.
JACCARD_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, l.y FROM reach JOIN links l ON l.x = reach.r)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s"""

#: Every 50-byte string of every document, as hexadecimal digits, from parts of 1024 bytes and what follows them.
SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, k, substr(h, 2048 * k + 1, 2048 + 98) AS part FROM (SELECT doc_id, h, unnest(range(length(h) // 2048 + 1)) AS k FROM b)),
p AS (SELECT doc_id, k, part, unnest(range(least(1024, length(part) // 2))) AS i FROM k),
w AS (SELECT doc_id, 1024 * k + i AS pos, substr(part, 2 * i + 1, 2) AS byte, CASE WHEN 2 * (i + 50) <= length(part) THEN substr(part, 2 * i + 1, 100) END AS win FROM p),
m AS (SELECT win, min(doc_id) AS first_doc FROM w WHERE win IS NOT NULL GROUP BY win),
x AS (SELECT doc_id, pos, byte, COALESCE(first_doc < doc_id, false) AS hit FROM w LEFT JOIN m USING (win)),
c AS (SELECT doc_id, pos, byte, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM x),
l AS (SELECT *, COALESCE(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM c),
r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, COALESCE(string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM l GROUP BY doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256 FROM b LEFT JOIN r USING (doc_id)"""


#: The crc32 of a string x by the table method: t has the 256 remainders.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"


def _crc32(x: str) -> str:
    data = f"list_transform(range(1, length(hex(encode({x}))), 2), lambda k: ('0x' || substr(hex(encode({x})), k, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def quality_rules() -> str:
    """Counts from positions of words, and fences from bucket counts of each group, its language and all rows."""
    from .quality import LEAST_ROWS, REACH, RULES

    rates = " UNION ALL ".join(f"SELECT lang, source, {k} AS rule, 1000 * {r.count} // n_words AS v FROM c WHERE NOT base_failed" for k, r in enumerate(RULES))
    spread = "CASE rule " + " ".join(f"WHEN {k} THEN {r.spread}" for k, r in enumerate(RULES)) + " END"

    def fence(name: str, keys: str) -> str:
        sums = f"SELECT {keys}rule, b, sum(count(*)) OVER (PARTITION BY {keys}rule ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY {keys}rule) AS m FROM v GROUP BY {keys}rule, b"
        return f"{name} AS (SELECT {keys}rule, max(m) AS m, min(b) FILTER (WHERE 4 * upto >= m) AS lo, min(b) FILTER (WHERE 4 * upto >= 3 * m) AS hi FROM ({sums}) GROUP BY {keys}rule)"

    def held(k: int, r) -> str:
        above = f"1000 * {r.count} <= max(hi) FILTER (WHERE rule = {k}) * n_words + {1000 * r.slack}"
        return above + (f" AND 1000 * {r.count} >= max(lo) FILTER (WHERE rule = {k}) * n_words - {1000 * r.slack}" if r.both else "")

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM p, range(5) AS o(k) GROUP BY r),
n AS (SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(q.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN q ON w.r = q.r),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n),
v AS (SELECT lang, source, rule, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS b FROM ({rates})),
{fence('f', 'lang, source, ')}, {fence('fl', 'lang, ')}, {fence('fa', '')},
e AS (SELECT f.lang, f.source, f.rule, CASE WHEN f.m >= {LEAST_ROWS} THEN f.lo WHEN fl.m >= {LEAST_ROWS} THEN fl.lo ELSE fa.lo END AS a, CASE WHEN f.m >= {LEAST_ROWS} THEN f.hi WHEN fl.m >= {LEAST_ROWS} THEN fl.hi ELSE fa.hi END AS b
  FROM f JOIN fl ON f.lang IS NOT DISTINCT FROM fl.lang AND f.rule = fl.rule JOIN fa ON fa.rule = f.rule),
t AS (SELECT lang, source, rule, a - {REACH} * greatest(b - a, {spread}) AS lo, b + {REACH} * greatest(b - a, {spread}) AS hi FROM e),
k AS (SELECT r, {' AND '.join(f'({held(k, r)})' for k, r in enumerate(RULES))} AS fine FROM c JOIN t ON c.lang IS NOT DISTINCT FROM t.lang AND c.source IS NOT DISTINCT FROM t.source GROUP BY r, {', '.join(dict.fromkeys([*(x.count for x in RULES), 'n_words']))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND COALESCE(fine, false) AS kept FROM c LEFT JOIN k ON c.r = k.r"""


#: Whole counts by bucket, then one sort of all scores.
IMPORTANCE_RESAMPLING = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS w FROM d),
y AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
b AS (SELECT w, {_crc32('w')} % 10000 AS b FROM (SELECT w FROM x UNION SELECT w FROM y), crc),
s AS (SELECT b, count(*) AS s FROM x JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM y JOIN b USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b),
m AS (SELECT r, sum(g)::BIGINT AS weight FROM x JOIN b USING (w) JOIN g ON g.b = b.b GROUP BY r),
n AS (SELECT d.r, doc_id, COALESCE(len(w), 0)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m ON m.r = d.r),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM n),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM o LEFT JOIN k ON o.r = k.r"""


def _sized(x: str) -> str:
    return f"COALESCE(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(map(_sized, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: Trees level by level, then every leaf's way up.
MERKLE_MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf()} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf()} END AS shown FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS i FROM d),
nodes AS (SELECT lang, 0 AS level, i, leaf AS h FROM p
  UNION ALL SELECT lang, level + 1, i // 2, sha256(h || COALESCE(after, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS after, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 AND i % 2 = 0),
subs AS (SELECT lang, max(level) AS top, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS k FROM nodes GROUP BY lang),
tops AS (SELECT 0 AS level, k AS i, subroot AS h FROM subs
  UNION ALL SELECT level + 1, i // 2, sha256(h || COALESCE(after, '')) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS after, count(*) OVER () AS n FROM tops) WHERE n > 1 AND i % 2 = 0),
root AS (SELECT max(level) AS height, arg_max(h, level) AS root FROM tops),
steps AS (SELECT p.r, l.level, n.h AS sibling, (p.i >> l.level) & 1 AS right_side FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, LATERAL (SELECT unnest(range(subs.top)) AS level) l LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = l.level AND n.i = xor(p.i >> l.level, 1)
  UNION ALL SELECT p.r, subs.top + l.level, t.h, (subs.k >> l.level) & 1 FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, LATERAL (SELECT unnest(range(height)) AS level FROM root) l LEFT JOIN tops t ON t.level = l.level AND t.i = xor(subs.k >> l.level, 1)),
fold AS (SELECT r, 0 AS level, shown AS h FROM p
  UNION ALL SELECT f.r, f.level + 1, sha256(CASE WHEN right_side = 1 THEN COALESCE(sibling, '') || h ELSE h || COALESCE(sibling, '') END) FROM fold f JOIN steps s ON s.r = f.r AND s.level = f.level),
proof AS (SELECT r, sha256(COALESCE(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, COALESCE(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang JOIN root ON true LEFT JOIN proof ON proof.r = p.r JOIN (SELECT r, arg_max(h, level) AS folded_root FROM fold GROUP BY r) z ON z.r = p.r"""
