"""The registered queries op1 to op10 over whole tables of sf0.001, against brute force, the libraries and DuckDB."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from weftline.llm import quality, queries
from weftline.llm.oracles import ORACLE_SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_bpe(spark, documents):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    made = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op1_bpe(spark, DIR).collect()}
    for doc, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert made.pop(doc) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    assert not made


def test_op2_sharding(spark, documents):
    texts = dict(documents)
    rows = queries.op2_sharding(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots: dict = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 0 < moved < len(rows) / 6


def test_op3_jaccard_join(spark, documents):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_jaccard_join(spark, DIR).collect()} == brute.jaccard_components(documents)


def test_op4_embedding_dedup(spark):
    from tests.llm.test_embedding_dedup import brute_force

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    expected, links = brute_force(rows)
    made = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_embedding_dedup(spark, DIR).collect()}
    assert set(made) == set(expected) and all(kept == (component == vec) for vec, (_, component, kept) in made.items())
    assert sum(n for n, *_ in made.values()) >= 0.9 * 2 * links  # recall
    assert all(n <= expected[vec][0] for vec, (n, *_) in made.items())  # precision: a link found is a link


def test_op5_substring_dedup(spark, documents):
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, DIR).collect()} == brute.substring_removal(documents)


def test_op6_suffix_dedup(spark, documents):
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op6_suffix_dedup(spark, DIR).collect()} == brute.byte_removal(documents)


def test_op8_token_output(spark, documents):
    from weftline.llm.token_output import encoder

    rows = queries.op8_token_output(spark, DIR).collect()
    sizes = {doc: len(encoder(queries.tokenizer_path("byte_bpe_50k.tiktoken"))([(text or "").encode()])[0]) + 1 for doc, text in documents}
    total: dict = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == sizes and sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_op9_quality(spark, documents):
    """Scores against the same model solved directly: all labelled statistics in one matrix, one ridge system, one isotonic fit."""
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()]
    texts = dict(documents)
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    taught = sorted({(d, int(y)) for d, y in labels if y in (0, 1) and not held_out(d) and d in texts})
    x = quality.statistics([(texts[d] or "").encode() for d, _ in taught])
    y = np.array([y for _, y in taught], dtype=float)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(taught, "doc_id long, quality int"))
    np.testing.assert_allclose(model.center, x.mean(0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(model.scale, np.maximum(x.std(0), 1e-6), rtol=1e-6, atol=1e-9)
    f = model.fourier(x)
    solved = np.linalg.solve(f.T @ f + 1e-3 * len(y) * np.eye(f.shape[1]) / len(model.phase), f.T @ y)
    np.testing.assert_allclose(model.solved, solved, rtol=1e-5, atol=1e-7)
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.edges) > 0).all()
    wanted = np.clip(np.interp(model.fourier(quality.statistics([(t or "").encode() for _, t in documents])) @ solved, model.edges, model.levels), 0, 1)
    made = {r["doc_id"]: r for r in queries.op9_quality(spark, DIR).collect()}
    for (doc, _), score in zip(documents, wanted, strict=True):
        r = made[doc]
        assert abs(r["score"] - score) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held_out(doc)


def test_isotonic_is_the_nearest_non_decreasing_sequence():
    """Against the min-max formula over all intervals."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        v, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        mean = lambda a, b, v=v, w=w: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        wanted = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        np.testing.assert_allclose(quality.isotonic(v, w), wanted)


def test_op10_decontamination(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    made = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op10_decontamination(spark, DIR).collect()}
    assert made == brute.contamination(documents, items)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DIR):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{DIR}/{table}'")
    made, df = con.sql(ORACLE_SQL[name]), queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    assert sorted(made.columns) == columns
    place = [made.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in place) for r in made.fetchall())


def test_digest_of_no_text():
    assert queries.digests(b"", "") == (hashlib.sha256(b"").hexdigest(),) * 2
