"""Blocks of documents, and packed exchange of hashes between blocks and hash buckets.

A block is a set of documents chosen by a hash of doc_id, about `block_bytes` of text; a bucket is
a range of hash values. What blocks send to buckets, and what buckets answer, travels as packed
arrays, one row for each (block, bucket), each value once for each block: a value shared by a third
of all documents costs its bucket one entry a block, not one a document. Both sizes are bounds on
what a task holds; `plan` raises the two together as the corpus grows, so that their product, the
number of packed rows, stays far below the number of values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import pieces, quoted, small_batches

NULL_ID = np.iinfo(np.int64).min  # a null doc_id sorts before every other


@dataclass(frozen=True)
class Plan:
    blocks: int
    buckets: int


def plan(total_bytes: int, block_bytes: int = 6 << 20, bucket_bytes: int = 12 << 20) -> Plan:
    """Up to 100 GB of text the sizes are the given ones; beyond, they grow with its square root, to 30 times at 100 TB."""
    grow = max(1.0, math.sqrt(total_bytes / 100e9))
    return Plan(pieces(total_bytes, int(block_bytes * grow)), pieces(total_bytes, int(bucket_bytes * grow)))


def blocked(df: DataFrame, id_col: str, text_col: str, carried: list[str], blocks: int) -> DataFrame:
    """__block, __id (long), __text, and the carried columns in one struct __row, so that no name clashes."""
    small_batches(df.sparkSession)
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in carried)) if carried else F.struct(F.lit(0).alias("none"))
    return df.select(block_of(F.col(quoted(id_col)).cast("long"), blocks).alias("__block"), F.col(quoted(id_col)).cast("long").alias("__id"), F.col(quoted(text_col)).cast("string").alias("__text"), row.alias("__row"))


def block_of(id_column, blocks: int):
    return F.pmod(F.xxhash64(id_column), F.lit(blocks)).cast("int")


def ids(t: pa.Table) -> np.ndarray:
    return t.column("__id").fill_null(int(NULL_ID)).to_numpy().astype(np.int64)


def by_id(t: pa.Table) -> pa.Table:
    """Rows in order of doc_id; everything computed of a block refers to this order."""
    return t.combine_chunks().take(pa.array(np.argsort(ids(t), kind="stable")))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def split(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each run of a non-decreasing array."""
    if not len(buckets):
        return []
    at = np.flatnonzero(np.diff(buckets)) + 1
    begins, ends = np.concatenate(([0], at)), np.concatenate((at, [len(buckets)]))
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(begins, ends, strict=True)]


def in_several(values: np.ndarray) -> np.ndarray:
    """Which entries have a value that another entry has too."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v) + 1, dtype=bool)
    same[1:-1] = v[1:] == v[:-1]
    out = np.zeros(len(v), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def shared_values(t: pa.Table) -> pa.Table:
    """Of a bucket's rows (bucket, block, packed 32-bit values): a bit for each value that another entry has too."""
    packed = t.column("packed").to_pylist()
    sizes = [len(p) // 4 for p in packed]
    flags = in_several(np.frombuffer(b"".join(packed), dtype="<u4"))
    ends = np.cumsum(sizes)
    found = [(bucket, block, np.packbits(flags[e - n : e]).tobytes()) for bucket, block, n, e in zip(t.column("bucket").to_pylist(), t.column("__block").to_pylist(), sizes, ends, strict=True) if flags[e - n : e].any()]
    return pa.table({"__block": pa.array([b for _, b, _ in found], pa.int32()), "bucket": pa.array([k for k, _, _ in found], pa.int32()), "bits": pa.array([x for *_, x in found], pa.binary())})


def shared_classes(t: pa.Table) -> pa.Table:
    """As shared_values, and for each marked value a byte: the binary logarithm of the number of blocks that have it."""
    packed = t.column("packed").to_pylist()
    values = np.frombuffer(b"".join(packed), dtype="<u4")
    order = np.argsort(values, kind="stable")
    v = values[order]
    edge = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.concatenate((edge, [len(v)])))
    classes = np.zeros(len(v), dtype=np.uint8)
    classes[order] = np.repeat(np.log2(np.maximum(times, 1)).astype(np.uint8), times)
    found, at = [], 0
    for bucket, block, p in zip(t.column("bucket").to_pylist(), t.column("__block").to_pylist(), packed, strict=True):
        own = classes[at : at + len(p) // 4]
        at += len(own)
        if own.any():
            found.append((block, bucket, np.packbits(own > 0).tobytes(), own[own > 0].tobytes()))
    kinds = (("__block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("classes", pa.binary()))
    return pa.table({n: pa.array([f[k] for f in found], kind) for k, (n, kind) in enumerate(kinds)})


CLASSES_SCHEMA = "__block int, bucket int, bits binary, classes binary"
SHARED_SCHEMA = "__block int, bucket int, bits binary"
PACKED_SCHEMA = "bucket int, __block int, packed binary"


def pack_values(block: int, h: np.ndarray, buckets: int) -> pa.Table:
    """Sorted distinct 64-bit hashes as one row for each bucket; the lower 32 bits tell them apart inside a bucket."""
    runs = split(bucket_of(h, buckets))
    return pa.table(
        {
            "bucket": pa.array([k for k, _, _ in runs], pa.int32()),
            "__block": pa.array([block] * len(runs), pa.int32()),
            "packed": pa.array([(h[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for _, a, b in runs], pa.binary()),
        }
    )


def unpack_bits(h: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The answers of shared_values as one flag for each of the hashes that pack_values was given."""
    out = np.zeros(len(h), dtype=bool)
    told = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    for k, a, b in split(bucket_of(h, buckets)):
        if k in told:
            out[a:b] = np.unpackbits(np.frombuffer(told[k], dtype=np.uint8), count=b - a).astype(bool)
    return out


def unpack_classes(h: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The answers of shared_classes as one class for each of the hashes that pack_values was given; 0 for those of one block."""
    out = np.zeros(len(h), dtype=np.uint8)
    told = {k: (bits, classes) for k, bits, classes in zip(*(answers.column(c).to_pylist() for c in ("bucket", "bits", "classes")), strict=True)}
    for k, a, b in split(bucket_of(h, buckets)):
        if k in told:
            bits, classes = told[k]
            out[a:b][np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)] = np.frombuffer(classes, dtype=np.uint8)
    return out
