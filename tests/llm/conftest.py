import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, secrets string, start string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    body = " ".join(f"word{k} and thing{k * 7 % 13}" for k in range(60))
    long = "\n".join(" ".join(f"w{(k * 31 + j) % 9973}" for j in range(12)) for k in range(6000))
    texts = [(1, body), (2, body), (3, body.replace("word5 ", "changed ")), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "one two"), (9, long), (10, "Été ß 漢字 " + body[:200]), (11, "x" * 3000), (7, "one two"), (None, "no id here at all, sorry")]
    return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t), 0.5, 1, "s", "t") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
