import hashlib
import random
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwright.llm import fingerprints, ngram_join, suffix_dedup
from inkwright.llm.components import components
from inkwright.llm.suffix_array import common_prefixes, suffix_array


def brute_components(rows, width=5, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


def edited(spark, n=120, seed=3):
    """Chains and stars of near copies, copies, and texts around one common passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2) + str(rng.randint(0, 400))
    common, texts = [word() for _ in range(25)], []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = rng.choice(texts)[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(3, 80))] + (common if kind < 0.75 else [])
        texts.append(w)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def test_ngram_join(spark, odd, empty):
    rows = edited(spark)
    sets, parts = brute_components(rows)
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), parts[i]) for i in sets}
    assert any(parts[i] != i for i in parts)
    got = ngram_join.linked_documents(odd).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == odd.count()
    assert found[2][1] == 1 and found[3][1] == 1 and found[8] == (1, 7) and found[4] == (0, 4) and found[5] == (0, 5) and found[None][1] is None
    assert ngram_join.linked_documents(empty).count() == 0


def test_ngram_join_in_parts(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    body, rows = [word() for _ in range(60)], []
    for k in range(120):
        text = list(body) if k % 3 else [word() for _ in range(40)]
        for _ in range(rng.choice((0, 1, 2, 4))):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    sets, named = brute_components(rows)
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), named[i]) for i in sets}
    assert max(list(named.values()).count(x) for x in named.values()) > 20


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 103), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    from inkwright.llm import components as module

    names, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    n = 5000
    links = spark.range(1, n).selectExpr("id AS a", "id + 1 AS b").union(spark.range(9).selectExpr("id + 10000", "10009"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {k: 1 for k in range(1, n + 1)} | {k: 10000 for k in range(10000, 10010)}
    assert names.count("edges") - 1 < 20


def test_ngram_join_of_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda: [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60)]
    a, b = text(), text()
    near = lambda t: " ".join([*t[:-1], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, None), (4, near(a) + " more"), (None, near(a)), (5, " ".join(text()))]
    want = {1: {1}, 2: {1}, 3: {1}, 4: {1}, 5: {5}, None: {None}}
    for order in (rows, rows[::-1]):
        for parts in (1, 5):
            got = ngram_join.linked_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(parts)).collect()
            found = {}
            for r in got:
                found.setdefault(r["doc_id"], set()).add(r["component_id"])
            assert found == want and len(got) == len(rows)
            assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 4) == [0, 57]


def test_ngram_join_pairs_large_groups_by_length(spark, monkeypatch):
    rng = random.Random(21)
    template, rows = [f"t{k}" for k in range(60)], []
    for k in range(90):  # own words before the template; few of them link, many share every gram of it
        rows.append((k, " ".join([f"own{rng.randint(0, 40)}" for _ in range(rng.randint(0, 24))] + template[: rng.randint(45, 60)])))
    sets, named = brute_components(rows)
    for small in (0, 10_000):
        monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
        got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), named[i]) for i in sets}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=80))
def test_suffix_array(values):
    s = np.asarray([*values, 0], np.int16)
    sa, text = suffix_array(s, 258), s.tolist()
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    prefix = common_prefixes(s.astype(np.uint8), sa, 10)
    for a, b in zip(sa, sa[1:]):
        same = 0
        while same < 10 and max(a, b) + same < len(text) and text[a + same] == text[b + same]:
            same += 1
        assert prefix[b] == same


def brute_dedup(rows):
    seen, out = set(), {}
    for i in sorted({r[0] for r in rows}):
        new = set()
        for _, t in [r for r in rows if r[0] == i]:
            b = (t or "").encode()
            cover = bytearray(len(b))
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    cover[k : k + 50] = b"\1" * 50
                new.add(b[k : k + 50])
            runs = sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1]))
            out[i] = (len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, v in zip(b, cover) if not v)).hexdigest())
        seen |= new
    return out


def test_suffix_dedup(spark, odd, empty):
    rng = random.Random(5)
    passage = "".join(rng.choice("abc dé") for _ in range(90))
    rows = []
    for k in range(60):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))
        if k % 3 == 0:
            t = t[:100] + passage[rng.randint(0, 45) :] + t[100:]
        if k % 7 == 6:
            t = rows[-1][1]
        if k == 40:
            t = "ab" * 2000
        if k == 41:
            t = "xyz" + "ab" * 700
        rows.append((k, t))
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == brute_dedup(rows)
    got = suffix_dedup.deduplicated(odd).collect()
    assert len(got) == odd.count()
    want = brute_dedup([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert {r["doc_id"]: tuple(r[1:]) for r in got if r["doc_id"] is not None} == want
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_dedup_sorts_only_what_may_repeat(monkeypatch):
    """A suffix array was made of all segments, most of which share a gram and nothing more."""
    rng = random.Random(7)
    word = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n)).encode()
    gram, passage = word(20), word(80)
    data = [word(30) + gram + word(30) for _ in range(400)] + [word(30) + passage + word(30) for _ in range(20)]
    shard = pd.DataFrame({"sid": [hashlib.md5(x).digest() for x in data], "first_doc": np.arange(len(data)), "data": data, "shard": 0})
    sizes, plan = [], suffix_dedup.Windows
    monkeypatch.setattr(suffix_dedup, "Windows", lambda texts, owners: sizes.append(sum(map(len, texts))) or plan(texts, owners))
    got = suffix_dedup._marked_shard(shard)
    found = {r.sid: [(s["start"], s["stop"]) for s in r.spans] for r in got.itertuples()}
    assert {k for k, v in found.items() if v} == set(shard["sid"][401:])
    assert all(20 < v[0][0] <= 30 and 110 <= v[-1][1] < 120 for v in found.values() if v)
    assert sum(sizes) < 4_000  # of 34,800


def test_marked_runs_are_those_of_the_whole():
    rng = random.Random(3)

    def cover(spans, size):
        out = np.zeros(size, bool)
        for a, b in spans:
            out[a:b] = True
        return out.tolist()

    for _ in range(60):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 70))) for _ in range(12)]
        texts = sorted({b"".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))})
        owners = np.asarray([rng.randrange(6) for _ in texts])
        whole, runs = suffix_dedup.marked(texts, owners), suffix_dedup.marked_runs(texts, owners)
        assert [cover(x, len(t)) for x, t in zip(whole, texts)] == [cover(x, len(t)) for x, t in zip(runs, texts)]
    assert suffix_dedup.marked_runs([b"", b"a" * 49], np.asarray([1, 2])) == [[], []]


def test_anchors_are_the_least_grams_of_windows():
    rng = random.Random(9)
    for letters in (b"a", b"ab", b"abcdefgh", bytes(range(256))):
        raw = [bytes(rng.choice(letters) for _ in range(n)) for n in (0, 49, 50, 51, 0, 300, 90)]
        text, place, h = (x.tolist() for x in suffix_dedup.anchors(raw))
        assert list(zip(text, place)) == sorted(set(zip(text, place)))
        by = {}
        for t, p, x in zip(text, place, h):
            assert by.setdefault(raw[t][p : p + 20], x) == x
        for t, x in enumerate(raw):
            for k in range(len(x) - 49):
                assert any(u == t and k <= p <= k + 30 for u, p in zip(text, place))
        windows = {}
        for t, x in enumerate(raw):  # equal windows have an anchor's gram in common
            for k in range(len(x) - 49):
                windows.setdefault(x[k : k + 50], []).append({raw[t][p : p + 20] for u, p in zip(text, place) if u == t and k <= p <= k + 30})
        assert all(set.intersection(*v) for v in windows.values())


def test_suffix_dedup_deals_large_names(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edges = word(200), [(word(40), word(40)) for _ in range(6)]
    rows = []
    for k in range(240):
        left, right = rng.choice(edges)
        rows.append((k, word(90) + left[rng.randint(0, 40) :] + passage + right[: rng.randint(0, 40)] + word(90)))
    sizes, plan = [], suffix_dedup._marked_segments

    def seen(segments):
        sizes.extend(r[0] for r in segments.groupBy("shard").agg({"data": "count"}).select("count(data)").collect())
        return plan(segments)

    monkeypatch.setattr(suffix_dedup, "_marked_segments", seen)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4096)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (docs, docs.coalesce(1)):  # in one task the passage's grams are hot ones
        got = suffix_dedup.deduplicated(parts).collect()
        assert {r["doc_id"]: tuple(r[1:]) for r in got} == brute_dedup(rows)
    assert max(sizes) < 60  # of some 240 segments around the passage


def test_suffix_dedup_hot_grams():
    rng = np.random.default_rng(1)
    gram = np.concatenate([np.full(100, 1 << 63, np.uint64), rng.integers(0, 1 << 63, 50, np.uint64)])
    key, place = rng.integers(-(1 << 62), 1 << 62, 150), np.arange(150, dtype=np.int32)
    rows = [(hot, *(np.frombuffer(c, t) for c, t in zip(columns, (np.uint64, np.int64, np.int32)))) for _, hot, *columns in suffix_dedup._dealt(gram, key, place, 7)]
    for kind, many in ((False, 50), (True, 100), (None, 2)):
        assert sum(len(r[1]) for r in rows if r[0] is kind) == many
    ends = [k for hot, _, k, _ in rows if hot is None for k in k.tolist()]
    assert sorted(ends) == [key[:100].min(), key[:100].max()]


def pieces(text):
    from collections import Counter

    out, seen = [], Counter()
    for line in text.split("\n"):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        for k in range(0, len(spans), 8):
            piece = line[spans[k][0] : spans[min(k + 7, len(spans) - 1)][1]]
            out.append((piece, seen[piece]))
            seen[piece] += 1
    return set(out)


def test_fingerprints(odd, empty):
    rows = sorted(((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (-x[0], x[1]))
    got = {}
    for r in fingerprints.fingerprints(odd).collect():
        got.setdefault(-(1 << 63) if r["doc_id"] is None else r["doc_id"], []).append(r)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        assert any(r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and abs(r["near_edited"] - alike(pieces(text), pieces(new))) < 1e-9 and abs(r["near_next"] - alike(pieces(text), pieces(following))) < 1e-9 for r in got[i])
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] != got[3][0]["fingerprint"]
    assert sum(map(len, got.values())) == len(rows)
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_of_hot_ids(spark):
    rng = random.Random(31)
    text = lambda: "\n".join(f"line {rng.randint(0, 50)}" for _ in range(rng.randint(0, 6)))
    rows = [(7, text()) for _ in range(90)] + [(None, text()) for _ in range(80)] + [(k, text()) for k in range(20)] + [(7, "same")] * 30 + [(9, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprints.with_following(docs)
    sizes = {r["range"]: r["count"] for r in dealt.filter("NOT ahead").groupBy("range").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 110 and dealt.filter("ahead").count() == len(sizes)
    got = fingerprints.fingerprints(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    # In one partition the same rows follow one another, so the edits are the same.
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    alone = fingerprints.fingerprints(docs.coalesce(1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, got)) == sorted(map(str, alone))


def test_likeness_of_stored_fingerprints(spark):
    lines = [f"line {k} with some words" for k in range(40)]
    texts = ["\n".join(lines), "\n".join([*lines[:38], "other"]), "\n".join(f"else {k}" for k in range(40)), "", "\n".join(lines)]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = [rows[k]["fingerprint"] for k in range(5)]
    assert fingerprints.likeness(prints[0], prints[1]) == 38 / 41 and fingerprints.likeness(prints[0], prints[4]) == 1.0
    assert fingerprints.likeness(prints[0], prints[2]) is None and fingerprints.likeness(prints[3], prints[3]) == 1.0 and fingerprints.likeness(None, prints[0]) is None
    for r in rows.values():
        alike = fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert alike is None or alike == r["near_edited"]
    frame = spark.createDataFrame([(prints[0], prints[1]), (prints[0], prints[2]), (None, prints[0])], "a string, b string")
    assert [r["v"] for r in frame.select(fingerprints.likeness_of("a", "b").alias("v")).collect()] == [38 / 41, None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.lists(st.integers(0, 30), max_size=60))
def test_fingerprints_recover_the_differing_digests(old, new):
    texts = ["\n".join(f"line {k}" for k in lines) for lines in (old, new)]
    owner, digest = fingerprints.piece_digests([t.encode() for t in texts])
    a, b = ({int(d) for d in digest[owner == k]} for k in (0, 1))
    assert fingerprints.differing_digests(*texts) == (sorted(a - b), sorted(b - a))
    assert fingerprints.differing_digests(None, texts[1])[0] == []
