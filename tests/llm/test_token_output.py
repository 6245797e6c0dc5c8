import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import token_output as O
from weftline.llm.queries import tokenizer_path


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    a, b = (O.feistel(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 10 or (a != b).any()
    assert (O.feistel(np.array([n - 1]), n, 1) == a[-1:]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.tiktoken"])
def test_round_trip_through_the_shards(spark, tmp_path, name):
    path = tokenizer_path(name)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    df = df.union(spark.createDataFrame([(900, None), (901, ""), (None, "a b"), (900, "a b")], "doc_id long, text string")).repartition(3)
    folder = f"file://{tmp_path}/shards"
    index, manifest = O.write_shards(df, path, folder, end_id=49407, pad_id=49406, length=64, shard_bytes=64 * 2 * 50)
    rows = sorted(index.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(manifest["sequences"])) and manifest["shards"] > 3
    read = list(O.read_sequences(folder))
    if name.endswith(".json"):
        encode = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    else:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
        encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    wanted = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple([*encode(r["text"] or ""), 49407])) for r in df.collect())
    parts: dict = {}
    for r in rows:
        parts.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["seq"], tuple(read[r["slot"]][: r["n_tokens"]].tolist())))
        assert (read[r["slot"]][r["n_tokens"] :] == 49406).all()
    assert {k: sum(len(s) for _, s in v) for k, v in parts.items()} == {k: sum(len(t) for d, t in wanted if d == k) for k, _ in wanted}
    for k, tokens in wanted:
        if k not in (900,):
            assert tuple(x for _, s in sorted(parts[k]) for x in s) == tokens
    assert [x.tolist() for x in O.read_sequences(folder, 77)] == [x.tolist() for x in read[77:]]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir() if p.suffix == ".bin"}
    (tmp_path / "shards" / O.shard_name(1)).write_bytes(b"torn")
    O.write_shards(df, path, folder, end_id=49407, pad_id=49406, length=64, shard_bytes=64 * 2 * 50)
    assert [x.tolist() for x in O.read_sequences(folder)] == [x.tolist() for x in read]
    assert {p.name for p in (tmp_path / "shards").iterdir() if p.suffix == ".bin" and p.stat().st_mtime_ns != before[p.name]} == {O.shard_name(1)}


def test_empty_table(spark, tmp_path):
    index, manifest = O.write_shards(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), f"file://{tmp_path}/none", end_id=1, pad_id=0)
    assert index.count() == 0 and manifest["sequences"] == 0 and list(O.read_sequences(f"file://{tmp_path}/none")) == []


def test_order_hangs_on_the_documents_alone(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80)
    path, size = tokenizer_path("byte_bpe_50k.tiktoken"), {"end_id": 50256, "pad_id": 50257, "length": 64, "shard_bytes": 64 * 2 * 50}
    made = []
    for k, frame in enumerate((df.repartition(5), df.orderBy("text").coalesce(1))):
        index, _ = O.write_shards(frame, path, f"file://{tmp_path}/{k}", **size)
        made.append(({(r["doc_id"], r["seq"], r["slot"], r["crc32"]) for r in index.collect()}, [x.tolist() for x in O.read_sequences(f"file://{tmp_path}/{k}")]))
    assert made[0] == made[1]
    # The same folder from another partitioning: every file is as it should be and stays.
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "0").glob("*.bin")}
    O.write_shards(df.repartition(2), path, f"file://{tmp_path}/0", **size)
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "0").glob("*.bin")}
    # A file of the right size with other bytes is written anew.
    name = tmp_path / "0" / O.shard_name(0)
    name.write_bytes(bytes(name.stat().st_size))
    O.write_shards(df, path, f"file://{tmp_path}/0", **size)
    assert [x.tolist() for x in O.read_sequences(f"file://{tmp_path}/0")] == made[0][1]


def test_a_folder_with_another_plan_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(k, "some words " * k) for k in range(30)], "doc_id long, text string")
    path, folder = tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/x"
    size = {"end_id": 50256, "pad_id": 50257, "length": 16, "shard_bytes": 16 * 2 * 10}
    O.write_shards(df, path, folder, key=1, **size)
    first = [x.tolist() for x in O.read_sequences(folder)]
    for frame, file, key in ((df, path, 2), (df, tokenizer_path(), 1), (df.where("doc_id > 0"), path, 1), (df.withColumn("text", F.upper("text")), path, 1)):
        with pytest.raises(ValueError, match="another"):
            O.write_shards(frame, file, folder, key=key, **size)
    assert [x.tolist() for x in O.read_sequences(folder)] == first
    index, _ = O.write_shards(df, path, folder, key=2, resume=False, **size)
    read = [x.tolist() for x in O.read_sequences(folder)]
    assert read != first and sorted(read) == sorted(first)
    assert all(zlib.crc32(np.array(read[r["slot"]], "<u2").tobytes()) == r["crc32"] for r in index.collect())


def test_large_ids_take_four_bytes(spark, tmp_path):
    index, manifest = O.write_shards(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/w", end_id=70_000, pad_id=70_001, length=8)
    assert manifest["kind"] == "<u4" and [x.tolist()[-1] for x in O.read_sequences(f"file://{tmp_path}/w")] == [70_001]
    assert 70_000 in next(O.read_sequences(f"file://{tmp_path}/w")).tolist() and index.count() == 1
