import random
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rank int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", ""]), st.text(alphabet="\\#/<>turn :\n Ab", max_size=40)), max_size=5))
def test_format_reads_back(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (1, 2, None, "", 9), (2, 0, "user", "x" * 200_000, 9), (3, 0, "user", "same", 9), (3, 0, "user", "same", 9), (None, 0, "user", "lost", 9)]
    out = {r["conv_id"]: r for r in chat.digests(chat.conversations(chat.chains(spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, 2: 1, 3: 2, None: 1}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\n\n\n").hexdigest()
    assert out[1]["loss_chars"] == 0
    assert out[2]["formatted_chars"] > 200_000


def test_empty(spark):
    assert chat.digests(chat.conversations(chat.chains(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_trees_rank_and_cycles(spark):
    rows = [("t", "a", None, 1.0, "user", "root"), ("t", "b", "a", 5.0, "assistant", "good"), ("t", "c", "a", 1.0, "assistant", "bad"), ("t", "d", "b", None, "user", "deep"), ("u", "x", "y", 1.0, "user", "cycle"), ("u", "y", "x", 1.0, "user", "cycle"), ("u", "z", "y", 1.0, "user", "tail"), ("v", "o", "gone", 1.0, "user", "orphan")]
    messages = spark.createDataFrame(rows, "tree string, node string, parent string, score double, role string, text string")
    out = {(r["tree"], r["rank"]): r for r in chat.conversations(messages, keep=2).collect()}
    assert set(out) == {("t", 1), ("t", 2), ("v", 1)}
    assert chat.parse_turns(out["t", 1]["formatted"]) == [("user", "root"), ("assistant", "good"), ("user", "deep")]
    assert chat.parse_turns(out["t", 2]["formatted"]) == [("user", "root"), ("assistant", "bad")]


def test_best_paths_of_random_trees(spark):
    rng = random.Random(8)
    rows, best = [], {}
    for tree in range(25):
        parents, score = {}, {}
        for n in range(rng.randint(1, 30)):
            node = f"{tree}/{n}"
            parents[node] = f"{tree}/{rng.randint(max(0, n - 4), n - 1)}" if n else None
            score[node] = float(rng.randint(-3, 9))
            rows.append((tree, node, parents[node], score[node], rng.choice(["user", "assistant"]), f"said {n} </turn>"))
        made = []
        for leaf in set(parents) - set(parents.values()):
            path = [leaf]
            while parents[path[-1]]:
                path.append(parents[path[-1]])
            made.append((-sum(score[x] for x in path), -len(path), leaf, path[::-1]))
        best[tree] = sorted(made)[:2]
    said = {r[1]: (r[4], r[5]) for r in rows}
    got = chat.conversations(spark.createDataFrame(rows, "tree long, node string, parent string, score double, role string, text string"), keep=2).collect()
    assert len(got) == sum(map(len, best.values()))
    for r in got:
        total, _, leaf, path = best[r["tree"]][r["rank"] - 1]
        assert (r["leaf"], r["score"]) == (leaf, -total)
        assert chat.parse_turns(r["formatted"]) == [said[x] for x in path]


def test_a_long_comb_takes_a_row_for_each_message(spark):
    rows = [(0, str(k), str(k - 1) if k else None, 0.0, "user", "x") for k in range(300)] + [(0, f"leaf{k}", str(k), float(k == 150), "user", "y") for k in range(300)]
    ids = spark.createDataFrame(rows, "tree long, node string, parent string, score double, role string, text string").cache()
    leaves, steps = chat.branches(ids)
    assert leaves.count() == 300 and max(s.count() for s in steps) <= len(rows)
    best = chat.conversations(ids).collect()
    assert [r["leaf"] for r in best] == ["leaf150"] and len(chat.parse_turns(best[0]["formatted"])) == 152


def test_cycles_and_unknown_parents(spark):
    rows = [(0, "a", "b", 0.0, "user", "x"), (0, "b", "a", 0.0, "user", "x"), (0, "c", "b", 9.0, "user", "x"), (1, "d", "nowhere", 0.0, None, None)]
    got = chat.conversations(spark.createDataFrame(rows, "tree long, node string, parent string, score double, role string, text string")).collect()
    assert [r["leaf"] for r in got] == ["d"] and chat.parse_turns(got[0]["formatted"]) == [("", "")]
