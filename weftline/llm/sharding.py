"""Sharding by jump consistent hashing.

The key is a 64-bit mix of doc_id; the jump function maps it to one of n shards with no table.
With n + 1 shards a row either stays or goes to the new shard. Slots number the rows of a shard
without gaps: rows of a shard are split by hash of the key into sub-buckets, the sub-buckets'
sizes are summed once (a table of shards x sub-buckets rows, whatever the data), and a row's slot
is the sum of the sub-buckets before its own plus its rank inside it. No shard is ever sorted in
one task, and texts are not shuffled: only id, size and checksum are.

Defined cases: a null doc_id is a key like any other; rows with equal doc_id share a shard; the
rank inside a sub-bucket is by (doc_id, size, checksum), so fully equal rows get neighbouring
slots in any order; a null text has size 1 and checksum 0; an empty table gives no rows; other
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import others, pieces, quoted

RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
ROWS_PER_BUCKET = 50_000
_STEP = np.uint64(2862933555777941757)  # fixed value of the published jump hash


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, by the published algorithm, for all keys at once."""
    keys = keys.astype(np.uint64).copy()
    b = np.zeros(len(keys), dtype=np.int64)
    going, nxt = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    while len(going):
        b[going] = nxt
        keys[going] = keys[going] * _STEP + np.uint64(1)
        ahead = ((b[going] + 1) * (float(1 << 31) / ((keys[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = ahead < shards
        going, nxt = going[on], ahead[on]
    return b.astype(np.int32)


def shard_column(key, shards: int):
    """The shard as a column, of a long column of mixed keys."""

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return run(key)


def shard(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET, keep_text: bool = False) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard were there one more)."""
    text = F.col(quoted(text_col))
    carried = others(docs, id_col, text_col, *RESULTS) + ([text_col] if keep_text else [])
    rows = docs.select(
        F.col(quoted(id_col)).alias("__id"),
        (F.struct(*(F.col(quoted(c)).alias(c) for c in carried)) if carried else F.lit(None)).alias("__row"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(quoted(id_col))).alias("__key"),
    )
    rows = rows.withColumn("shard", shard_column(F.col("__key"), shards)).withColumn("grown_shard", shard_column(F.col("__key"), shards + 1))
    n = docs.count()
    subs = pieces(n, shards * rows_per_bucket)
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(subs)).cast("int"))
    # One row for each (shard, sub-bucket): 16 x rows / 800,000.
    sizes = rows.groupBy("shard", "__sub").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "__sub", "__before")
    rank = F.row_number().over(Window.partitionBy("shard", "__sub").orderBy("__id", "size", "text_crc32"))
    placed = rows.withColumn("__rank", rank).join(before, ["shard", "__sub"])
    return placed.select(
        F.col("__id").alias(id_col),
        *(F.col("__row")[c].alias(c) for c in carried),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__before") + F.col("__rank") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
