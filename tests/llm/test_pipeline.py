import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm import brute
from weftline.llm.queries import tokenizer_path
from weftline.llm.shared import materialize

DIR = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    inputs = {}
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, DIR), "test")
        inputs[name] = (by_id(docs), by_id(out))
        assert out.columns[: len(names)] == names and len(inputs[name][1]) == out.count()
        docs = out
    before, after = inputs["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    right = [(d in after) == (labels[d] == 1) for d in before if d in labels]
    assert sum(right) >= 0.95 * len(right) and all(after[d] == before[d] for d in after)

    before, after = inputs["n-gram Jaccard join"]
    component = brute.jaccard_components([(d, r["text"]) for d, r in before.items()])
    assert set(after) == {d for d, (_, c) in component.items() if d == c} and all(after[d] == before[d] for d in after)

    before, after = inputs["substring dedup"]
    removed = brute.substring_removal([(d, r["text"]) for d, r in before.items()])
    assert set(after) == set(before)
    for d, (_, n, sha) in removed.items():
        if n:
            assert brute.sha(after[d]["text"].encode()) == sha and after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d] == before[d]

    before, after = inputs["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    found = brute.contamination([(d, r["text"]) for d, r in before.items()], items)
    assert set(after) == {d for d, x in found.items() if not x[4]} and all(after[d] == before[d] for d in after)

    before, after = inputs["BPE encoding and decoding"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for d, r in after.items():
        ids = tokenizer.encode(before[d]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_odd_documents(spark, tmp_path):
    docs = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "a few words only", "en", "s", 5, "x"), (3, "plain words that stay here " * 30, "en", "s", None, "x"), (3, "plain words that stay here " * 30, "en", "s", None, "x"), (4, "é" * 5000, None, "s", 1, "x")]
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, ids string"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None), (2, "")], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out) == [-1, 1, 2, 3, 4]
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
