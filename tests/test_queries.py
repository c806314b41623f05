"""Every query of the library itself against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwright import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)

    return sorted((tuple(map(one, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_packed_chunks_cover_the_text(spark, sf_dir):
    assert set(QUERIES) - set(SQL) == {"r03_ivf_recall"}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for name in ("c01_recursive_chunks", "c07_sentence_chunks"):
        held = {}
        for r in QUERIES[name](spark, sf_dir).collect():
            held.setdefault(r["doc_id"], []).append((r["index"], r["start"], r["stop"]))
        assert set(held) == {i for i, t in texts.items() if t.strip()}
        for i, parts in held.items():
            parts.sort()
            assert all(b <= c for (_, _, b), (_, c, _) in zip(parts, parts[1:]))
            if name.startswith("c01"):
                assert all(b - a <= 512 for _, a, b in parts)
                assert "".join("".join(texts[i][a:b] for _, a, b in parts).split()) == "".join(texts[i].split())


def test_results_are_not_trivial(spark, sf_dir):
    empty = [n for n in ("r07_hybrid_topk", "u07_missing", "t_k8_schools", "f18_slow_events", "e12_dictionary_entities") if QUERIES[n](spark, sf_dir).isEmpty()]
    assert not empty


@pytest.mark.parametrize("module, name, query, rows", [("records.R", "verification_confidence", "z27_verification_confidence", "events"), ("documents.T", "popularity_score", "r20_popularity", "part")])
def test_queries_return_what_the_operator_says(spark, sf_dir, duck, monkeypatch, module, name, query, rows):
    monkeypatch.setattr(f"inkwright.plans.{module}.{name}", lambda *a, **k: F.lit(777.0))
    got = QUERIES[query](spark, sf_dir).toPandas().drop(columns=["event_id", "p_partkey"], errors="ignore")
    assert len(got) == duck.execute(f"SELECT count(*) FROM {rows}").fetchone()[0] and (got == 777.0).all(axis=None)


def test_flagship(spark, sf_dir):
    rows = registry.flagship(spark, sf_dir).collect()
    assert len(rows) == 10 and rows[0]["rank"] == 1 and rows[0]["score"] == 1.0
