import zlib

import numpy as np

from weftline.llm import sharding as S


def jump_plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert S.jump(keys, n).tolist() == [jump_plain(int(k), n) for k in keys]
    old, new = S.jump(keys, 16), S.jump(keys, 17)
    assert set(new[old != new]) == {16} and 0.03 < (old != new).mean() < 0.09


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = S.shard(df, rows_per_bucket=20).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    assert len(rows) == len(docs)
    slots: dict = {}
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert {r["doc_id"]: r["shard"] for r in S.shard(df.where("doc_id < 50")).collect()}.items() <= {r["doc_id"]: r["shard"] for r in rows}.items()


def test_odd_tables(spark):
    rows = [(None, None, 1), (None, None, 2), (7, "x", 3), (7, "x", 4), (7, "", 5)]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()
    assert len(out) == 5 and len({(r["shard"], r["slot"]) for r in out}) == 5
    assert [(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None] == [(1, 0), (1, 0)]
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
