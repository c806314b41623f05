import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwright.llm import packing, sharding, token_files
from inkwright.llm.tokens import encoder, tokenizer_path

PATH = tokenizer_path()


def ids_of(text):
    return np.asarray(encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBé ÉßΣİ漢'.,%$<|>0 9\n\t\x1c\x85\u3000\u0301", max_size=60))
def test_word_cache_gives_the_tokenizers_ids(text):
    assert encoder(PATH).encode(text) + b"\x01\0\0\0" == ids_of(text).tobytes()


def test_token_files(odd, empty):
    rows = sorted(token_files.token_files(odd, PATH).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for row, (doc_id, text) in zip(rows, texts, strict=True):
        ids = ids_of(text)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(empty, PATH).count() == 0


def test_frames_are_independent_and_checked():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = io.BytesIO()
    writer = token_files.FrameWriter(out)
    docs = [np.arange(k * 40_000, dtype="<u4").tobytes() for k in (1, 0, 3, 12, 1)]
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader = token_files.FrameReader(Source(out.getvalue()))
    assert len(reader.sums) > 3
    assert [reader.ids(k) for k in (4, 3, 0, 1, 2)] == [docs[k] for k in (4, 3, 0, 1, 2)]
    damaged = bytearray(out.getvalue())
    damaged[40] ^= 1
    with pytest.raises(Exception):
        [token_files.FrameReader(Source(bytes(damaged))).ids(k) for k in range(5)]


def test_packing(odd, empty):
    rows = packing.packed_documents(odd, PATH, 256).toPandas()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert list(group.offset) == [0, *group.length.cumsum()[:-1]] and group.length.sum() <= 256
    first = rows[rows.doc_id == 9].sort_values("piece")
    whole = ids_of(texts[9])
    assert list(first.start) == list(range(0, len(whole), 256)) and (first.length[:-1] == 256).all()
    assert list(first.ids_crc32) == [zlib.crc32(whole[a : a + 256].tobytes()) for a in range(0, len(whole), 256)]
    assert (rows.doc_id == 7).sum() == 2
    assert packing.packed_documents(empty, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((s for s in free if s >= length), default=None)
            if fit is None:
                free.append(64 - length)
            else:
                free.remove(fit)
                free.append(fit - length)
    filled = {}
    for length, rank, count, base, at in packing.plan(histogram, 64):
        for k in range(count):
            filled.setdefault(base + k, []).append((at, length))
    assert len(filled) == len(free)
    for parts in filled.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 64


def test_sharding(spark, odd, empty, sf_dir):
    import duckdb

    from .sharding_sql import SQL

    rows = sharding.sharded(odd, 5).toPandas()
    assert len(rows) == odd.count()
    for _, group in rows.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert sharding.sharded(empty, 5).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.sharded(docs, 40).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    both = got.merge(con.execute(SQL).df(), on="doc_id", suffixes=("", "_sql"))
    assert len(both) == len(got)
    assert (both["shard"] == both["shard_sql"]).all() and (both["grown_shard"] == both["grown_shard_sql"]).all() and (both["size"] == both["size_sql"]).all()
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 40)).all()
