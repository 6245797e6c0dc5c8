"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Each block hashes every window of its documents (polynomials of the words' hashes modulo 2^64)
   and sends each distinct hash once to its bucket, as 32 bits inside the bucket.
2. A bucket counts them and answers with one bit a hash: does another block have it too?
3. For the hashes so marked, the block sends the 96-bit hash with the place (doc_id, start) of its
   own first occurrence; the bucket finds the first of all and answers which are later ones.
4. A block removes each window that is not the first occurrence in the block, or whose first in
   the block is a later one; overlapping windows merge into maximal intervals of words.

So a window that a third of all documents share is one entry a block. Hashes that differ are
different windows; equal 96-bit hashes are taken for equal windows (64 bits inside a block). The two
hashes of a window have hashes of its words of their own, which no arrangement of bytes cancels out.

Defined cases: null and empty texts have no words; null doc_ids come before all others; rows with
equal doc_id count as one document, so that their windows with equal start neither precede nor
remove each other; an empty table gives no rows; other columns pass through, those named like a
result are replaced. A text may be of any length: its words are read a megabyte at a time, and it
takes its worker about 13 bytes for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import blocks as B
from weftline.llm.shared import lean, others, text_bytes
from weftline.llm.wordhash import AS_IS, Words, raw

WIDTH = 20
#: Seed of the words' hashes and base of the windows' for the check that is independent of the first hash.
SECOND = (0x51ED270B7A3F12C5, 0x369DEA0F31A53F85)
RESULTS = ("n_words", "n_removed", "removed", "kept")
_MADE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))),
        T.StructField("kept", T.StringType()),
    ]
)
_ENTRY = "bucket int, __block int, hash binary, check binary, doc binary, start binary, place binary"


class Windows:
    """A block's windows: hash, document, start, and the first occurrence in the block of each distinct hash."""

    def __init__(self, t: pa.Table, width: int):
        self.table = B.by_id(t)
        self.docs = B.ids(self.table)
        self.texts = raw(self.table.column("__text"))
        self.words = Words(self.texts, AS_IS)
        self.at, self.hash = self.words.windows(width)
        owner = np.searchsorted(self.words.first, self.at, side="right") - 1
        self.doc, self.start = self.docs[owner], self.at - self.words.first[owner]
        if len(np.unique(self.docs)) < len(self.docs):
            order = np.lexsort((self.start, self.doc, self.hash))
        else:
            order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=bool)
        self.distinct, self.first = h[new], order[new]
        self.group = np.zeros(len(h), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed, removed (intervals of words) and kept (the words left, joined by one blank)."""
    carried = others(docs, id_col, text_col, *RESULTS)
    size = B.plan(text_bytes(docs, text_col))
    buckets = size.buckets
    parted = B.blocked(docs, id_col, text_col, carried, size.blocks)

    def send(t: pa.Table) -> pa.Table:
        w = Windows(t, width)
        return B.pack_values(t.column("__block")[0].as_py(), w.distinct, buckets)

    def claim(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _entries([])
        w = Windows(t, width)
        marked = B.unpack_bits(w.distinct, buckets, answers)
        chosen = w.first[marked]
        check = Words(w.texts, AS_IS, seed=SECOND[0]).windows(width, base=SECOND[1])[1][chosen]
        h = w.distinct[marked]
        rows = []
        for k, a, b in B.split(B.bucket_of(h, buckets)):
            order = a + np.argsort(chosen[a:b])
            place = chosen[order].astype(np.int64)
            rows.append((k, t.column("__block")[0].as_py(), h[order].astype("<u8").tobytes(), (check[order] >> np.uint64(32)).astype("<u4").tobytes(), np.diff(w.doc[place], prepend=0).astype("<i8").tobytes(), w.start[place].astype("<u4").tobytes(), np.diff(place, prepend=0).astype("<u4").tobytes()))
        return _entries(rows)

    def settle(t: pa.Table) -> pa.Table:
        rows = [c.to_pylist() for c in t.columns]
        hashes = np.frombuffer(b"".join(rows[2]), "<u8")
        checks, starts = np.frombuffer(b"".join(rows[3]), "<u4"), np.frombuffer(b"".join(rows[5]), "<u4")
        owners = np.concatenate([np.cumsum(np.frombuffer(x, "<i8")) for x in rows[4]])
        order = np.lexsort((starts, owners, checks, hashes))
        h, c, d, s = hashes[order], checks[order], owners[order], starts[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.zeros(len(h), dtype=bool)
        later[order] = (d != d[first]) | (s != s[first])
        out, at = [], 0
        for block, place in zip(rows[1], rows[6], strict=True):
            n = len(place) // 4
            told = np.cumsum(np.frombuffer(place, "<u4"))[later[at : at + n]]
            at += n
            if len(told):
                out.append((block, np.diff(told, prepend=0).astype("<u4").tobytes()))
        return pa.table({"__block": pa.array([b for b, _ in out], pa.int32()), "places": pa.array([p for _, p in out], pa.binary())})

    carried_type = parted.schema["__row"]
    schema = T.StructType([carried_type, T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType()), *_MADE])

    def remove(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _removed(t, [])
        w = Windows(t, width)
        flagged = np.zeros(len(w.distinct), dtype=bool)
        for x in answers.column("places").to_pylist():
            flagged[w.group[np.cumsum(np.frombuffer(x, "<u4"))]] = True
        first = w.first[w.group]
        later = flagged[w.group] | (w.doc != w.doc[first]) | (w.start != w.start[first])
        cover = np.zeros(len(w.words.hash) + width + 1, dtype=np.int32)
        np.add.at(cover, w.at[later], 1)
        np.add.at(cover, w.at[later] + width, -1)
        gone = np.cumsum(cover)[: len(w.words.hash)] > 0
        made = []
        for k, text in enumerate(w.texts):
            a, b = int(w.words.first[k]), int(w.words.first[k + 1])
            part, words = gone[a:b], text.split()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], part.view(np.int8), [0]))))
            kept = words if not len(edge) else [x for x, g in zip(words, part.tolist(), strict=True) if not g]
            made.append({"n_words": b - a, "n_removed": int(part.sum()), "removed": [{"first_word": int(x), "end_word": int(y)} for x, y in zip(edge[0::2], edge[1::2], strict=True)], "kept": b" ".join(kept).decode()})
        return _removed(w.table, made)

    # All three readers of the documents share one exchange by block.
    counted = parted.groupBy("__block").applyInArrow(lean(send), B.PACKED_SCHEMA).groupBy("bucket").applyInArrow(lean(B.shared_values), B.SHARED_SCHEMA)
    claims = parted.groupBy("__block").cogroup(counted.groupBy("__block")).applyInArrow(lean(claim), _ENTRY)
    later = claims.groupBy("bucket").applyInArrow(lean(settle), "__block int, places binary")
    out = parted.groupBy("__block").cogroup(later.groupBy("__block")).applyInArrow(lean(remove), schema)
    return out.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), *(F.col("__row")[c].alias(c) for c in carried), F.col("__text").alias(text_col), *(F.col(c) for c in RESULTS))


def _entries(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = ["bucket", "__block", "hash", "check", "doc", "start", "place"]
    return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})


_ARROW = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))), ("kept", pa.string())])


def _removed(t: pa.Table, made: list[dict]) -> pa.Table:
    new = pa.Table.from_pylist(made, schema=_ARROW)
    return pa.table({"__row": t.column("__row"), "__id": t.column("__id"), "__text": t.column("__text"), **{n: new.column(n) for n in _ARROW.names}})
