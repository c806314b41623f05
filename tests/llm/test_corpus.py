"""Quality rules, importance resampling and the Merkle manifest against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwright.llm import manifest, quality, resampling


def features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resampling(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    runs = lambda t: [" ".join(w[i : i + k]) for w in [features(t)] for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in runs(x)) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in runs(text))
        out.append([i, len(features(text)), len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    return Counter((*r, k + 1) for k, r in enumerate(drawn)) + Counter((*r, None) for r in [*able[len(drawn) :], *(r for r in out if r[1] < least)])


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, monkeypatch, longest):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "Γάμμα", "d3lta", "straße", "ÄÖ", "x" * 40, "foo-bar", "it's"]
    rows = [(i if i % 23 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(500, rows[5][1])] * 150 + [(501, None), (502, ""), (503, " ".join(words) * 500)]
    target = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(20)] + [None, ""]
    monkeypatch.setattr(resampling, "_SLICE", 64)
    monkeypatch.setattr(resampling, "COPIES", 7)
    monkeypatch.setattr(resampling, "SPAN", 512)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 10, 60, 100):
        got = resampling.resampled(docs, goal, longest=longest, percent=percent)
        assert as_rows(got) == plain_resampling(rows, target, longest, percent=percent)


def test_resampling_takes_odd_input(spark, odd, empty):
    goal = spark.createDataFrame([("one two word5",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_rows(resampling.resampled(odd, goal, percent=50)) == plain_resampling(rows, ["one two word5"], percent=50)
    assert as_rows(resampling.resampled(odd, goal.limit(0))) == plain_resampling(rows, [])
    assert resampling.resampled(empty, goal).count() == 0


def plain_manifest(rows, fanout):
    """Counter of (key, leaf, subroot, root, proof, folded) of (key, group, leaf, altered)."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            first = i - i % fanout
            yield level[first:i], level[i + 1 : first + fanout]
            i //= fanout

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in groups[g]]) for g in names}
    top, out = tree([trees[g][-1][0] for g in names]), Counter()
    for k, g in enumerate(names):
        for i, (key, _, own, shown) in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, k)]
            for left, right in steps:
                shown = h(*left, shown, *right)
            out[key, own, trees[g][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), shown, shown == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("fanout, unit", [(2, 8), (3, 9), (2, 1 << 15)])
def test_manifest(spark, monkeypatch, fanout, unit):
    rng = random.Random(fanout + unit)
    monkeypatch.setattr(manifest, "UNIT_ROWS", unit)
    name = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows = [(i if i % 17 else None, rng.choice(["en", "en", "en", "fr", "é", "", None]), name(i), name(i if i % 7 else -i)) for i in range(180)]
    rows += [(7, "en", name("same"), name("same"))] * 60 + [(1, "zz", name("alone"), name("alone"))]
    df = spark.createDataFrame(rows, "key long, grp string, leaf string, altered string").repartition(3)
    assert as_rows(manifest.manifest(df, fanout)) == plain_manifest(rows, fanout)


def test_document_manifest_takes_odd_input(spark, odd, empty):
    def sized(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def own(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return hashlib.sha256("".join(map(sized, (r["doc_id"], r["source"], r["lang"], n, r["text"]))).encode()).hexdigest()

    rows = [(r["doc_id"], r["lang"], own(r), own(r, (r["doc_id"] or 1) % 2 == 0)) for r in odd.collect()]
    got = manifest.document_manifest(odd, tampered=F.col("doc_id") % 2 == 0)
    assert as_rows(got) == plain_manifest(rows, 2)
    assert manifest.document_manifest(empty).count() == 0
    alone = manifest.document_manifest(odd.limit(1)).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["verified"] and alone["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        manifest.document_manifest(odd, fanout=1)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(5)}
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_verdicts(rows):
    def bucket(v):
        shift = max(0, v.bit_length() - 6)
        return v >> shift << shift

    def fence(values, rule):
        values = sorted(values)
        a, b = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
        wide = quality.REACH * max(b - a, rule.spread)
        return a - wide, b + wide

    counts = [dict(zip(quality.COUNTS, plain_counts(r[3]))) for r in rows]
    fails = [c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for c in counts]
    out = Counter()
    for (i, lang, source, _), c, failed in zip(rows, counts, fails):
        kept = not failed
        for rule in quality.RULES if kept else ():
            pools = [[bucket(1000 * d[rule.count] // d["n_words"]) for (_, g, s, _), d, f in zip(rows, counts, fails) if not f and same(g, s)] for same in (lambda g, s: (g, s) == (lang, source), lambda g, s: g == lang, lambda g, s: True)]
            pool = next((p for p in pools[:2] if len(p) >= quality.LEAST_ROWS), pools[2])
            low, high = fence(pool, rule)
            rate, n = 1000 * c[rule.count], c["n_words"]
            kept &= rate <= high * n + 1000 * rule.slack and not (rule.both and rate < low * n - 1000 * rule.slack)
        out[(i, *c.values(), failed, kept)] += 1
    return out


def test_quality_rules(spark, monkeypatch, odd, empty):
    monkeypatch.setattr(quality, "LEAST_ROWS", 30)
    rng = random.Random(3)
    words = "one three thousand words | ## repeated lines, über straße and longer".split()
    text = lambda n, k: "".join(rng.choice(words[:k]) + rng.choice([" ", " ", "\n", "\t\x0b", "  "]) for _ in range(n))
    rows = [(i, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None]), text(rng.randint(0, 80), len(words))) for i in range(250)]
    rows += [(900 + i, "en", "a", t) for i, t in enumerate([None, "", "x", "a b c d e f " * 9, "a b c d e f g h i j k\n" * 4, "#" * 900 + " a b c d e f g h i j k", " ".join(["w" * 300] * 3 + [f"v{k}" for k in range(20)]), "\x85　 \x1c nel " * 12])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("kept", F.lit(1)).repartition(3)
    want = plain_verdicts(rows)
    assert as_rows(quality.quality_verdicts(df)) == want
    kept = Counter(r[0] for r in want.elements() if r[-1])
    clean = quality.clean_documents(df)
    assert clean.columns == df.columns and Counter(r["doc_id"] for r in clean.collect()) == kept
    assert as_rows(quality.quality_verdicts(odd)) == plain_verdicts([(r["doc_id"], r["lang"], r["source"], r["text"]) for r in odd.collect()])
    assert quality.quality_verdicts(empty).count() == quality.clean_documents(empty).count() == 0
    only_short = odd.filter("doc_id IN (4, 5, 7)")
    assert {r["kept"] for r in quality.quality_verdicts(only_short).collect()} == {False}
