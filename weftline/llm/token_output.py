"""Token-ID output in training order: a keyed Feistel permutation gives every sequence its slot.

1. Documents are dealt in blocks by a hash of id and text, ordered by id and text inside a block, and
   encoded once, by the file of a public tokenizer (`.tiktoken` ranks, which give back every byte, or
   a `.json` file by way of bpe); they are kept as little-endian 16- or 32-bit ids (by the vocabulary's
   size), each with the end-of-document id after it, in a table in the shared folder. A document is
   cut into sequences of `length` ids; its last one is filled up with the pad id. Blocks number their
   sequences, and the blocks' sums (one row a block) make the numbers global. So the numbers hang on
   the documents alone, not on files, partitions or the cluster.
2. A Feistel network over the next even power of two permutes numbers 0 to N - 1: results of N or
   more walk on through the network until they fall below N. Equal key and N give equal order.
3. Slots are dealt by range: shard s holds slots s * per_shard and on. A task sorts one shard and
   writes it as one file of records of a fixed stride, under a temporary name that is then moved, so
   that a lost or repeated task leaves whole files only. Shards are written in `waves`, each with
   its own shuffle, whose files are dropped before the next.

The record of slot k begins at byte (k mod per_shard) * stride of file k div per_shard, so a reader
can start at any slot and read on in order. What a folder is to hold (key, tokenizer, documents,
layout) is written to plan.json before any shard. A run that resumes in a folder with another plan is
refused; files that are there with the very bytes are kept; the manifest is written last. With
resume=False the folder is emptied first.

Defined cases: a null or empty text is one sequence that holds the end-of-document id alone;
null doc_ids are kept as null; repeated documents have sequences of their own; an empty table
writes no shard and a manifest with 0 sequences; other columns do not matter.
A text may be of any length: it is encoded whole and cut into as many sequences as it takes.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.bpe import codec
from weftline.llm.shared import lean, materialize, new_path, pieces, quoted, slices, small_batches
from weftline.llm.wordhash import mix, raw

LENGTH, SHARD_BYTES, WAVES, ROUNDS = 256, 32 << 20, 2, 6


def feistel(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n - 1 chosen by the key, applied to the given numbers."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def open_folder(uri: str):
    """The file system of a folder and the folder's path in it; s3a and s3n are other names of s3."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///") if uri.startswith("file:/") else f"file://{uri}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


@lru_cache(4)
def encoder(path: str):
    """A function from texts to their ids; loaded once a worker."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        return lambda texts: [encode(t.decode()) for t in texts]
    many = codec(path).encode_many
    return lambda texts: [np.frombuffer(i, "<u4") for i in many(texts)]


def vocabulary(path: str) -> tuple[int, str]:
    """(the largest id, a digest) of a tokenizer's file."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".tiktoken"):
        largest = max((int(line.split()[1]) for line in data.splitlines() if line.strip()), default=0)
    else:
        declared = json.loads(data)
        largest = max([*declared["model"]["vocab"].values(), *(t["id"] for t in declared.get("added_tokens", []))], default=0)
    return largest, hashlib.sha256(data).hexdigest()


def encode_store(docs: DataFrame, path: str, end_id: int, blocks: int, *, id_col: str, text_col: str, length: int, kind: str) -> DataFrame:
    """One row a document: id, ids as bytes, and the number of its first sequence among its block's."""

    def run(t: pa.Table) -> pa.Table:
        encode, size = encoder(path), np.dtype(kind).itemsize
        end = np.array([end_id], dtype=kind).tobytes()
        texts, known = raw(t.column("text")), t.column("id").fill_null(int(B.NULL_ID)).to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (known[k], texts[k]))
        texts = [texts[k] for k in order]
        ids = [i.astype(kind).tobytes() + end for a, b in slices(texts) for i in encode(texts[a:b])]
        n = np.array([-(-len(i) // size // length) for i in ids], dtype=np.int64)
        return pa.table({"id": t.column("id").take(pa.array(order)), "block": t.column("block"), "first": pa.array(np.cumsum(n) - n), "n": pa.array(n), "ids": pa.array(ids, pa.binary())})

    read = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    dealt = read.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text")
    return materialize(dealt.groupBy("block").applyInArrow(lean(run), "id long, block int, first long, n long, ids binary"), "tokens")


def _agree(filesystem, root: str, plan: dict, resume: bool) -> None:
    """Writes the plan into a folder that has none; a folder with another plan, or with shards but no plan, is refused (or emptied)."""
    from pyarrow import fs

    name = f"{root}/plan.json"
    if not resume:
        filesystem.delete_dir_contents(root)
    if filesystem.get_file_info(name).type == fs.FileType.File:
        with filesystem.open_input_stream(name) as f:
            if json.loads(f.read()) != plan:
                raise ValueError(f"{root} holds shards of another key, tokenizer, layout or table; take another folder, or resume=False to empty it")
        return
    if filesystem.get_file_info(fs.FileSelector(root)):
        raise ValueError(f"{root} holds files but no plan; take another folder, or resume=False to empty it")
    with filesystem.open_output_stream(name) as out:
        out.write(json.dumps(plan).encode())


def write_shards(docs: DataFrame, path: str, folder: str | None = None, *, end_id: int, pad_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = 20240601, shard_bytes: int = SHARD_BYTES, waves: int = WAVES, resume: bool = True) -> tuple[DataFrame, dict]:
    """Writes the shards to `folder` (a new one in the shared folder if None); returns the index of all sequences and the manifest.

    The index has a row for each sequence: doc_id, seq, n_tokens, slot, shard, offset and crc32 of its record.
    """
    spark = docs.sparkSession
    small_batches(spark)
    largest, tokenizer = vocabulary(path)
    kind = "<u2" if max(largest, end_id, pad_id) < 1 << 16 else "<u4"
    stride = length * np.dtype(kind).itemsize
    per_shard = max(1, shard_bytes // stride)
    folder = folder or new_path(spark, "shards")
    filesystem, root = open_folder(folder)
    filesystem.create_dir(root, recursive=True)
    rows = F.xxhash64(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string"))
    told = docs.agg(F.sum(F.octet_length(F.col(quoted(text_col)).cast("string"))).alias("bytes"), F.count("*").alias("n"), F.bit_xor(rows).alias("x"), F.sum(F.pmod(rows, F.lit(1 << 31))).alias("s")).first()
    blocks = B.plan(told["bytes"] or 0).blocks
    plan = {"tokenizer": tokenizer, "documents": [told["n"], told["x"], told["s"]], "blocks": blocks, "length": length, "stride": stride, "per_shard": per_shard, "key": key, "kind": kind, "pad_id": pad_id, "end_id": end_id}
    _agree(filesystem, root, plan, resume)
    store = encode_store(docs, path, end_id, blocks, id_col=id_col, text_col=text_col, length=length, kind=kind)
    sums = store.groupBy("block").agg(F.sum("n").alias("n"))
    n = sums.agg(F.sum("n")).first()[0] or 0
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a block
    shards = pieces(n, per_shard, least=0)
    manifest = plan | {"sequences": n, "shards": shards}

    def sequences(lo: int, hi: int):
        def run(batches):
            for batch in batches:
                cols: list[list] = [[] for _ in range(5)]
                counts, bases = batch.column("n").to_numpy(), batch.column("first").to_numpy() + batch.column("before").to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), counts)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                slots = feistel(bases[owner] + inner, n, key)
                take = np.flatnonzero((slots >= lo * per_shard) & (slots < hi * per_shard))
                held: tuple[int, bytes] = (-1, b"")
                for o, i in zip(owner[take].tolist(), inner[take].tolist(), strict=True):
                    if held[0] != o:
                        held = (o, batch.column("ids")[o].as_py())
                    cols[4].append(held[1][i * stride : (i + 1) * stride])
                ids = batch.column("id").take(pa.array(owner[take]))
                yield pa.RecordBatch.from_arrays([pa.array((slots[take] // per_shard).astype(np.int32)), pa.array(slots[take]), ids, pa.array(inner[take]), pa.array(cols[4], pa.binary())], names=["shard", "slot", "id", "seq", "ids"])

        return run

    def write(t: pa.Table) -> pa.Table:
        from pyarrow import fs

        t = t.sort_by("slot")
        shard, made, pad = t.column("shard")[0].as_py(), t.column("ids").to_pylist(), np.full(length, pad_id, dtype=kind).tobytes()
        records = [x + pad[len(x) :] for x in made]
        target, at = open_folder(folder)
        name = f"{at}/{shard_name(shard)}"
        there, whole = target.get_file_info(name), b"".join(records)
        kept = there.type == fs.FileType.File and there.size == len(whole)
        if kept:
            with target.open_input_stream(name) as f:
                kept = f.read() == whole
        if not kept:
            context = TaskContext.get()
            temporary = f"{at}/.{shard_name(shard)}.{context.taskAttemptId()}"
            with target.open_output_stream(temporary) as out:
                out.write(whole)
            target.move(temporary, name)
        size = np.dtype(kind).itemsize
        return pa.table(
            {
                "doc_id": t.column("id"),
                "seq": t.column("seq"),
                "n_tokens": pa.array([len(x) // size for x in made], pa.int64()),
                "slot": t.column("slot"),
                "shard": t.column("shard"),
                "offset": pa.array((t.column("slot").to_numpy() % per_shard) * stride, pa.int64()),
                "crc32": pa.array([zlib.crc32(x) for x in records], pa.int64()),
            }
        )

    schema = "doc_id long, seq long, n_tokens long, slot long, shard int, offset long, crc32 long"
    placed = store.join(F.broadcast(before), "block")  # blocks grow with the square root of the text: 540,000 rows at 100 TB
    each = pieces(shards, waves)
    index = [materialize(placed.mapInArrow(lean(sequences(lo, min(shards, lo + each))), "shard int, slot long, id long, seq long, ids binary").groupBy("shard").applyInArrow(lean(write), schema), "slots") for lo in range(0, shards, each)]
    with filesystem.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return (reduce(DataFrame.union, index) if index else spark.createDataFrame([], schema)), manifest | {"folder": folder}


def read_sequences(folder: str, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences from slot `start` on, in order; a reader resumes by the number of sequences it has seen."""
    filesystem, root = open_folder(folder)
    with filesystem.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    slot = start
    while slot < m["sequences"]:
        shard, offset = slot // m["per_shard"], (slot % m["per_shard"]) * m["stride"]
        with filesystem.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(offset)
            while record := f.read(m["stride"]):
                yield np.frombuffer(record, m["kind"])
                slot += 1
