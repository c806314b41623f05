"""Alignment scopes, persons, speeches, timelines and resolvers on rows worked by hand, and against plain versions."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from inkwright.operators import evidence, narratives, resolvers


def plain_score(claim, segment, groups):
    norm = lambda t: re.sub(r"[\W_]+", "", re.sub(r"\([^)]*\)|（[^）]*）", "", t)).lower()
    a, b = norm(claim), norm(segment)
    if not a or not b:
        return 0.0
    han = lambda t: set(re.findall("[㐀-鿿]", t))
    pairs = lambda t: {t[k : k + 2] for k in range(len(t) - 1) if re.search("[㐀-鿿]", t[k : k + 2])}
    share = lambda x, y: len(x & y) / max(1, len(x))
    active = [w for w in groups.values() if any(x in claim for x in w)]
    cues = sum(any(x in segment for x in w) for w in active) / len(active) if active else 0.0
    return min(1.0, SequenceMatcher(None, a[:400], b[:400]).ratio() * 0.2 + share(han(claim), han(segment)) * 0.35 + share(pairs(a), pairs(b)) * 0.25 + cues * 0.2)


def plain_trim(claim, segment, groups):
    text = " ".join(re.split(r"E\d{6,}", segment, maxsplit=1)[0].split())
    if len(text) <= 260:
        return text
    best, top = text, plain_score(claim, text, groups)
    for k in range(0, max(1, len(text) - 219), 60):
        if (s := plain_score(claim, text[k : k + 220], groups)) > top:
            best, top = text[k : k + 220], s
    return best


def plain_align(claim, pages, groups):
    found = []
    for page, text in pages:
        for segment in (b.strip() for b in re.split(r"\n{2,}", text) if b.strip()):
            if len(" ".join(segment.split())) >= 20:
                found.append((plain_score(claim, segment, groups), page, segment))
    if not found:
        return None, "", None
    top = max(x[0] for x in found)
    score, page, segment = next(x for x in found if x[0] == top)
    return page, plain_trim(claim, segment, groups), round(score, 4)


def plain_scopes(claim, cited, mode, claims, pages, groups):
    inside = [p for p in pages if p[0] in cited]
    around = [p for p in pages if p[0] not in cited]
    if not cited:
        return (*plain_align(claim, pages, groups), "all_extracted_pages")
    if not inside:
        return (*plain_align(claim, pages, groups), "context_fallback")
    if mode == "distributed_pages" and len(inside) >= 2:
        each = [plain_align(c, inside, groups) for c in claims[:8]]
        if any(t for _, t, _ in each):
            best = max(each, key=lambda x: x[2] or 0.0)
            return best[0], "\n\n".join(f"[p{p}] {t}" for p, t, _ in each if t), max(s for _, _, s in each if s is not None), "distributed_cited_pages"
    used = list(inside)
    if mode == "continuous_range" and len(inside) >= 2:
        used.append((min(p for p, _ in inside), "\n\n".join(t for _, t in sorted(inside) if t)))
    page, text, score = plain_align(claim, used, groups)
    if around:
        p, t, s = plain_align(claim, around, groups)
        near = p is not None and min(abs(p - c) for c in cited) <= 1
        if p is not None and s > (score or 0.0) + 0.15 and s >= 0.30 and near and (not text or (score or 0.0) < 0.20):
            return p, t, s, "context_promoted_from_cited_pages"
    if text:
        return page, text, score, "cited_pages"
    return (*plain_align(claim, pages, groups), "context_fallback")


def test_page_priority_alignment(spark):
    rng = random.Random(7)
    han = "満洲鉄道史料研究制度維持実践調査記録東京大阪会議条約日本国政府外交文書"
    text = lambda n: "".join(rng.choice(han + "、。 ") for _ in range(n))
    groups = {"rail": ["鉄道", "鉄"], "state": ["国政府"]}
    cases, pages = [], []
    for k in range(36):
        claim = text(rng.randint(12, 60))
        cited = rng.sample(range(1, 6), rng.choice((0, 1, 1, 2, 3)))
        mode = rng.choice(("distributed_pages", "continuous_range", "single_page"))
        here = []
        for page in range(1, 6):
            if rng.random() < 0.85:
                parts = [text(rng.choice((5, 30, 80, 330))) for _ in range(rng.randint(0, 3))]
                if rng.random() < 0.3:
                    parts.append("E1234567 no" if rng.random() < 0.2 else claim[: rng.randint(8, 60)] + text(20) + ("E1234567 and more" if rng.random() < 0.5 else ""))
                here.append((page, rng.choice(("\n\n", "\n\n\n")).join(parts)))
        if k % 6 == 5:
            here = [(p, "a plain passage in Latin letters") for p, _ in here]
        cases.append((k, claim, cited, mode, [claim[:9], claim[9:]], here))
        pages += [(k, n, p, t) for n, (p, t) in enumerate(here)]
    frame = spark.createDataFrame([c[:5] for c in cases], "candidate_id int, claim string, cited array<int>, mode string, claims array<string>")
    got = {r["candidate_id"]: r for r in evidence.page_priority_alignment(frame, spark.createDataFrame(pages, "candidate_id int, ordinal int, page int, text string").repartition(3), groups).collect()}
    scopes = set()
    for k, claim, cited, mode, claims, here in cases:
        want = plain_scopes(claim, cited, mode, claims, here, groups)
        r, scopes = got[k], scopes | {want[3]}
        assert r["scope"] == want[3] and r["page"] == want[0] and r["matched"] == want[1], (k, tuple(r), want)
        assert r["score"] is want[2] is None or abs(r["score"] - want[2]) <= 1.01e-4
    assert len(scopes) >= 4 and len(got) == len(cases)


def test_aligned_candidates(spark):
    claims = spark.createDataFrame([(1, "維持制度の実践"), (1, "別の主張である鉄道"), (2, "満洲鉄道")], "candidate_id int, claim string")
    passages = spark.createDataFrame([(1, 4, "制度維持の実践手順を詳しく述べ、結論を示す記録。\n\n鉄道について別の主張がなされている長い記録。"), (1, 3, "天気は晴れで、海は静かであり、船は港を出た。"), (2, 9, "短い鉄道")], "candidate_id int, page int, text string")
    got = {(r["candidate_id"], r["claim"]): (r["page"], r["segment"][:2], round(r["score"], 3)) for r in evidence.aligned(claims, passages, {}).collect()}
    text = passages.collect()[0]["text"].split("\n\n")
    assert got == {(1, "維持制度の実践"): (4, "制度", round(plain_score("維持制度の実践", text[0], {}), 3)), (1, "別の主張である鉄道"): (4, "鉄道", round(plain_score("別の主張である鉄道", text[1], {}), 3))}


def test_person_blocks(spark):
    texts = [
        (1, "山田太郎 氏\n本籍： 東京府, 芝区\n東京大学 卒業\n昭和10年4月 満鉄調査部 入社\n大正5年 大連銀行 勤務\n1941年12月8日 新京放送局 長\n短"),
        (2, "題\n佐藤次郎（さとう）談\n出身地：長野県"),
        (3, "nothing of the kind"),
        (4, "5年-10年 某公司 勤務\nまた 昭和3年 某 なし"),
        (5, None),
        (6, "　鈴木一　\n生于大連市，後に"),
    ]
    blocks = spark.createDataFrame(texts, "block int, text string")
    found = narratives.person_blocks(blocks)
    got = {r["block"]: r for r in found.collect()}
    assert set(got) == {1, 2, 4, 6}
    assert (got[1]["name"], got[1]["hometown"], got[1]["education"]) == ("山田太郎", "東京府", "東京大学")
    assert [(e["unit"], e["start"]["year"], e["start"]["month"], e["stop"]["day"]) for e in got[1]["experiences"]] == [("大正5年 大連銀行", 1916, 1, 1), ("昭和10年4月 満鉄調査部", 1935, 4, 1), ("1941年12月8日 新京放送局", 1941, 12, 8)]
    assert got[2]["name"] == "佐藤次郎" and got[2]["hometown"] == "長野県" and got[2]["experiences"] == []
    assert got[4]["name"] is None and [(e["date_range"], e["start"]) for e in got[4]["experiences"]] == [("5年-10年", None)]
    assert got[6]["name"] == "鈴木一" and got[6]["hometown"] == "生于大連市"
    told = narratives.person_summary(blocks, found).first()
    assert (told["blocks"], told["persons"], told["named"], told["careers"]) == (6, 4, 3, 2)
    assert told["flags"] == ["empty_text_blocks", "person_missing_name", "person_missing_work_experiences"]


def test_speeches(spark):
    rng = random.Random(5)
    bits = ["「", "」", "『", "』", "（", "）", "(", ")", "曰く", "、", "と申候", "候", "と", "云", "西園寺公", "原敬氏", "伊藤より", "天皇　陛下", "\n", "これは", "text ", "述"]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(90, None), (91, "x" * 30 + "原敬　曰「" + "y" * 120 + "」と述")]
    got = {}
    for r in narratives.speeches(spark.createDataFrame(texts, "id int, text string"), "id").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["kind"], r["text"], r["start"], r["stop"], r["speaker"], r["confidence"]))
    for k, text in texts:
        want = []
        for pattern, kind in narratives.SPEECHES:
            for m in re.finditer(pattern, text or ""):
                before, speaker = text[max(0, m.start() - 100) : m.start()], ""
                for p in narratives.SPEAKERS:
                    if hit := re.search(p + r"\s*$", before):
                        name = re.sub(r"[　\s]+", "", hit.group(1).strip())
                        if name and len(name) <= 20:
                            speaker = name
                            break
                want.append((kind, m.group(1).strip(), m.start(), m.end(), speaker, 0.8 if speaker else 0.6))
        assert got.get(k, []) == want, k


def plain_timeline(text):
    out = []
    for pattern, _ in narratives.DATED:
        for m in re.finditer(pattern, text):
            groups = m.groups()
            date, event = "".join(g for g in groups[:-1] if g), groups[-1] or groups[0]
            if date and event:
                out.append((date.strip(), event.strip()))
                break
    if not out:
        for y, m, d in re.findall(narratives.YEARS, text):
            at = text.find(y)
            out.append((y + (f"-{m}" if m else "") + (f"-{d}" if d else ""), text[at : at + 50]))
    return out


def test_timeline(spark):
    texts = ["1904年3月5日：開戦\n1905年 講和", "1990年", "in 1990年\n5/6 event", "see 1931-12-5 and 1932", "none", "", "1990年\n1991年後", "12/25日 a\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [tuple(e) for e in r["t"]] for r in rows.select("id", narratives.timeline(F.col("text")).alias("t")).collect()}
    assert got == {k: plain_timeline(t) for k, t in enumerate(texts)}


def test_configured_sources(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    items = [(k, f"s{rng.randint(0, 9)}" if k % 7 else "", [word() for _ in range(rng.randint(0 if k < 3 else 1, 3))], k % 11 == 0) for k in range(40)]
    asked = [(k, [word() for _ in range(rng.randint(0, 4))]) for k in range(30)] + [(99, ["國會・學", "・"])]
    items.append((40, "kanji", ["国会学"], False))
    want = {}
    for k, terms in asked:
        keys = {t if t.isascii() else "国会学" for t in terms} - {"・"}
        found = []
        for ord_, source, own, default in items:
            hits = sum(any(a in b or b in a for b in keys) for a in set(own))
            fits = not own or hits or (default and not terms)
            if fits and source:
                found.append((-hits, ord_, source))
        seen = []
        for hits, _, source in sorted(found):
            if source not in [s for s, _ in seen]:
                seen.append((source, -hits))
        want[k] = seen
    left = spark.createDataFrame(asked, "id int, terms array<string>")
    right = spark.createDataFrame(items, "ord int, source_id string, terms array<string>, is_default boolean")
    got = {k: [] for k, _ in asked}
    for r in resolvers.configured_ids(left, right).orderBy("id", "rank").collect():
        got[r["id"]].append((r["source_id"], r["hits"]))
    assert got == want
    documents = resolvers.configured_documents(left, right.withColumn("kinds", F.array("source_id", F.lit("x"), F.lit(None))), ["kinds"])
    for r in documents.collect():
        assert "x" in r["kinds"] and None not in r["kinds"] and r["items"] == sorted(r["items"]) and len(set(r["source_ids"])) == len(r["source_ids"])


def test_equivalent_sources(spark):
    candidates = spark.createDataFrame([(1, "論文", "満洲国史 第三巻"), (2, "X", None), (3, None, None), (4, "", "")], "id int, title string, host_title string")
    matches = [(1, 0, "a", "満洲國史"), (1, 1, "b", "満洲国史（下巻）"), (1, 2, "b", "満洲国史"), (1, 3, "c", "満洲国史・１２号"), (1, 4, "k", "other"), (2, 0, "z", "x"), (3, 0, "p", "書 上巻"), (3, 1, "q", "書"), (4, 0, None, "t")]
    configured = spark.createDataFrame([(1, 0, "k"), (1, 1, "new"), (2, 0, "z")], "id int, ordinal int, source_id string")
    frame = spark.createDataFrame(matches, "id int, ordinal int, source_id string, title string")
    got = [tuple(r) for r in resolvers.equivalent_sources(candidates, frame, configured).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "b", "match", 2), (1, 2, "c", "match", 4), (1, 3, "k", "match", 5), (1, 4, "new", "configured", None), (3, 1, "p", "match", 1), (3, 2, "q", "match", 2)]
    many = spark.createDataFrame([(1, k, f"m{k}", "満洲国史") for k in range(20)], frame.schema)
    assert resolvers.equivalent_sources(candidates, many, configured).count() == 8


def test_narrowest_ranges(spark):
    rng = random.Random(11)
    span = lambda n: sorted((rng.randint(1, 60), rng.randint(1, 60))) if n else (rng.randint(1, 60),) * 2
    cached = [(rng.randint(0, 3), *span(rng.random() < 0.8), k) for k in range(80)] + [(1, 9, 3, 99)]
    asked = sorted({(rng.randint(0, 4), *span(rng.random() < 0.6)) for _ in range(60)})
    want = {}
    for i, a, b in asked:
        fits = [(d - c, o, c, d) for j, c, d, o in cached if j == i and c <= a and d >= b and d >= c]
        if fits:
            want[i, a, b] = min(fits)[1:]
    frames = spark.createDataFrame(asked, "id int, start int, stop int"), spark.createDataFrame(cached, "id int, c_start int, c_stop int, ordinal int")
    got = {(r["id"], r["start"], r["stop"]): (r["ordinal"], r["c_start"], r["c_stop"]) for r in evidence.narrowest_range(*frames).collect()}
    assert got == want
    assert evidence.narrowest_range(frames[0], frames[1].limit(0)).count() == 0
