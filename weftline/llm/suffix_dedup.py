"""Suffix-array dedup: repeated byte strings found as common-prefix intervals.

Suffixes that share `width` bytes must meet in one task, without every suffix travelling. Each
window of `width` bytes is assigned to its anchor: the smallest hash among its grams of `gram`
bytes (the leftmost of equals). Equal windows have equal anchors, and one anchor serves a run of
neighbouring windows, so a piece of text (the run's windows, less than 2 x width bytes) stands for
all of them.

1. Blocks send the distinct hashes of their anchors; buckets answer which of them occur elsewhere.
2. For shared or repeated anchors the distinct pieces of the block travel, each once with the place
   of its first occurrence. In the bucket equal pieces collapse to the first of all; the distinct
   pieces of an anchor are joined to one string with its enhanced suffix array (suffix order by
   prefix doubling, common-prefix lengths). A stack scan walks its tree of common-prefix intervals;
   intervals of `width` or more whose members differ in the byte to their left are maximal repeat
   groups, with all their occurrences. All but a group's first occurrence are marked.
3. Blocks remove what is marked: all windows of a piece that is not its first, and of a first piece
   the windows marked in the groups. Runs of removed bytes merge to maximal spans.

A piece that a third of all documents share is one entry a block. An anchor with more than
`together` pieces over all blocks (a common line with differing surroundings) is split: its windows
travel singly, by a 128-bit hash to a bucket of their own, each distinct one once a block, so no
task gathers all pieces of a common anchor.

Defined cases: null and empty texts have no bytes; null doc_ids come before all others; rows with
equal doc_id count as one document, windows of theirs with equal start do not remove each other;
spans may cut characters (they are bytes; `kept` is binary); an empty table gives no rows; other
columns pass through, those named like a result are replaced.
A text may be of any length; it is one row of its block, so its worker must hold it and arrays of 8 bytes for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import blocks as B
from weftline.llm.shared import lean, others, text_bytes
from weftline.llm.wordhash import U, byte_values, mix, prefix_sums, raw

WIDTH, GRAM = 100, 32
#: Pieces of one anchor, summed over blocks, that still meet in one task; bytes of pieces sorted at once; members of groups marked at once.
TOGETHER, SORTED_BYTES, MEMBERS = 1024, 1 << 18, 1 << 18
RESULTS = ("n_bytes", "n_removed", "removed", "kept")
_MADE = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)
_GRAM_BASE, _PIECE_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def enhanced_suffix_array(data: np.ndarray, owner: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the wanted suffixes by their bytes up to the end of their piece, and their common prefixes.

    data: bytes of pieces one after the other; owner: the piece of each byte. The order is exact
    for prefixes up to `depth` bytes at least. lcp[k] is the common prefix of order[k-1] and
    order[k], 0 for k = 0; no common prefix goes beyond a piece.
    """
    n = len(data)
    left = np.searchsorted(owner, owner, side="right") - np.arange(n)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    packed, small = data.astype(U), [(1, data.astype(U))]
    for k in range(1, 8):
        packed = (packed << U(8)) | np.where(left > k, padded[k : k + n], 0).astype(U)
        if k in (1, 3):
            small.append((k + 1, packed))
    rank = np.unique(packed, return_inverse=True)[1].ravel().astype(np.int64)
    # The end of a piece comes before any byte, also before a byte 0.
    rank, ranks, step = np.unique(rank * 9 + np.minimum(left, 8), return_inverse=True)[1].ravel().astype(np.int64) + 1, small, 8
    while step < depth:
        ranks.append((step, rank))
        after = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(left > step)
        after[inside] = rank[inside + step]
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1].ravel().astype(np.int64) + 1
        step *= 2
    ranks.append((step, rank))
    order = wanted[np.argsort(rank[wanted], kind="stable")]
    lcp = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        room, common = np.minimum(left[a], left[b]), lcp[1:]
        for size, r in reversed(ranks):
            live = np.flatnonzero(room - common >= size)
            same = live[r[a[live] + common[live]] == r[b[live] + common[live]]]
            common[same] += size
    return order, lcp


def repeat_groups(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, begin, end): the maximal repeats of `least` or more are the suffixes order[begin:end].

    One scan with a stack of open common-prefix intervals. before[k] is the byte left of suffix
    order[k], -1 where there is none; an interval counts if its members differ in it, or if one
    has none (two without any differ too).
    """
    found: list[tuple[int, int, int]] = []
    near = np.flatnonzero((lcp >= least) | np.concatenate((lcp[1:] >= least, [False]))) if len(lcp) else np.zeros(0, dtype=np.int64)
    lcp, before = np.where(lcp[near] >= least, lcp[near], 0), before[near]
    stack: list[list[int]] = []  # [length, begin, byte to the left of all members or -1]
    lefts = before.tolist()
    for k, common in enumerate([*lcp[1:].tolist(), 0][: len(near)], start=1):
        begin, diverse = k - 1, lefts[k - 1]
        while stack and stack[-1][0] > common:
            length, begin, byte = stack.pop()
            diverse = byte if byte == diverse else -1
            if diverse == -1:
                found.append((length, int(near[begin]), int(near[k - 1]) + 1))
        if common >= least:
            if stack and stack[-1][0] == common:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == diverse else -1
            else:
                stack.append([common, begin, diverse])
        elif stack:
            raise AssertionError("an interval outlived its prefix")
    return found


class Anchors:
    """A block's pieces: place, length and anchor hash of each, in order of doc_id and start."""

    def __init__(self, t: pa.Table, width: int, gram: int):
        self.table = B.by_id(t)
        self.docs = B.ids(self.table)
        self.texts = raw(self.table.column("__text"))
        docs, begins, counts, anchors, pieces = [], [], [], [], []
        at = 0
        while at < len(self.texts):
            upto, held = at, 0
            while upto < len(self.texts) and (upto == at or held + len(self.texts[upto]) < 1 << 18):
                held += len(self.texts[upto])
                upto += 1
            for found, into in zip(self._pieces(at, upto, width, gram), (docs, begins, counts, anchors, pieces), strict=True):
                into.append(found)
            at = upto
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.row, self.begin, self.count = cat(docs, np.int64), cat(begins, np.int64), cat(counts, np.int64)
        self.anchor, self.piece = cat(anchors, U), cat(pieces, U)
        self.doc = self.docs[self.row] if len(self.row) else np.zeros(0, dtype=np.int64)

    def _pieces(self, at: int, upto: int, width: int, gram: int):
        part = self.texts[at:upto]
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        first = np.concatenate(([0], np.cumsum(sizes)))
        if len(data) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        values = byte_values(data)
        sums, down = prefix_sums(values, _GRAM_BASE)
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
        # The least of the window's grams by its upper 32 bits, the leftmost of equals by the lower ones.
        low = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)
        span, have = width - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        chosen = (low & U(0xFFFFFFFF)).astype(np.int64)  # of each window of the joined texts
        own = np.repeat(np.arange(len(part)), sizes)
        valid = own[: len(chosen)] == own[width - 1 : width - 1 + len(chosen)]
        new = valid.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~valid[:-1] | (own[1 : len(chosen)] != own[: len(chosen) - 1])
        starts = np.flatnonzero(new)
        stop = np.flatnonzero(valid & ~np.concatenate((valid[1:] & ~new[1:], [False])))
        counts = stop - starts + 1
        psums, pdown = prefix_sums(values, _PIECE_BASE)
        ends = stop + width
        content = mix((psums[ends] - psums[starts]) * pdown[starts] + (counts + U(1 << 40)).astype(U) * U(0x9E3779B97F4A7C15))
        # Least hashes crowd at the low end; mixed again they spread evenly over buckets.
        return own[starts] + at, starts - first[own[starts]], counts, mix(h[chosen[starts]] ^ U(0x6A09E667F3BCC909)), content

    def bytes_of(self, k: int, width: int) -> bytes:
        return self.texts[self.row[k]][self.begin[k] : self.begin[k] + self.count[k] + width - 1]

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first piece of each distinct content (anchor and piece hash), and the group of each piece."""
        if len(np.unique(self.docs)) < len(self.docs):
            order = np.lexsort((self.begin, self.doc, self.piece, self.anchor))
        else:
            order = np.lexsort((self.piece, self.anchor))
        a, p = self.anchor[order], self.piece[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1]))) if len(a) else np.zeros(0, dtype=bool)
        group = np.zeros(len(a), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group


def mark(texts: list[bytes], docs: np.ndarray, begins: np.ndarray, width: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]], np.ndarray]:
    """Which windows of each distinct piece also start earlier in another, by the maximal repeat groups of the pieces.

    Also returns the groups as (length, begin, end) and the suffixes as rows (document, start): the
    occurrences of a group are the rows begin to end.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    windows = sizes - width + 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    order, lcp = enhanced_suffix_array(data, owner, np.repeat(first[:-1], windows) + inner, int(sizes.max()))
    piece = owner[order]
    inner = order - first[piece]
    left = np.where(inner > 0, data[np.maximum(order - 1, 0)].astype(np.int64), -1)
    groups = repeat_groups(order, lcp, left, width)
    place = np.column_stack((docs[piece], begins[piece] + inner))
    cover = np.zeros(len(data) + 1, dtype=np.int64)
    if groups:
        length, a, b = np.array(groups, dtype=np.int64).T
        sorting = np.lexsort((place[:, 1], place[:, 0]))
        rank = np.zeros(len(order), dtype=np.int64)
        rank[sorting] = np.concatenate(([0], np.cumsum((np.diff(place[sorting], axis=0) != 0).any(axis=1))))
        # Groups nest, so their members together can be many times the suffixes: a bounded number at a time.
        turn = np.cumsum(b - a) // MEMBERS
        for lo, hi in zip((edge := [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(a)])[:-1], edge[1:], strict=True):
            first_of, count = a[lo:hi], (b - a)[lo:hi]
            start = np.cumsum(count) - count
            group = np.repeat(np.arange(hi - lo), count)
            member = np.arange(count.sum()) - start[group] + first_of[group]
            later = rank[member] != np.minimum.reduceat(rank[member], start)[group]
            at, n = order[member[later]], length[lo:hi][group[later]] - width + 1
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
    on = np.cumsum(cover) > 0
    return [on[f : f + n] for f, n in zip(first[:-1].tolist(), windows.tolist(), strict=True)], groups, place


def _anchor_counts(t: pa.Table, together: int) -> pa.Table:
    """As blocks.shared_values, for hashes that come with the number of pieces: shared (or repeated), and hot."""
    packed, times = t.column("packed").to_pylist(), t.column("times").to_pylist()
    values, n = np.frombuffer(b"".join(packed), "<u4"), np.frombuffer(b"".join(times), "<u2").astype(np.int64)
    _, inverse, blocks = np.unique(values, return_inverse=True, return_counts=True)
    total = np.bincount(inverse.ravel(), weights=n).astype(np.int64)
    hot = (total > together)[inverse.ravel()]
    shared = ((blocks[inverse.ravel()] > 1) | (n > 1)) & ~hot
    ends = np.cumsum([len(p) // 4 for p in packed])
    rows = []
    for bucket, block, p, e in zip(t.column("bucket").to_pylist(), t.column("__block").to_pylist(), packed, ends, strict=True):
        a = e - len(p) // 4
        if shared[a:e].any() or hot[a:e].any():
            rows.append((block, bucket, np.packbits(shared[a:e]).tobytes(), np.packbits(hot[a:e]).tobytes() if hot[a:e].any() else None))
    return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate((("__block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("hot", pa.binary())))})


class SingleWindows:
    """The windows of hot anchors' pieces, one by one: the first in the block of each distinct one, and the group of each."""

    def __init__(self, x: Anchors, pieces: np.ndarray, width: int):
        texts = [x.bytes_of(k, width) for k in pieces.tolist()]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        counts = x.count[pieces]
        first = np.concatenate(([0], np.cumsum(counts + width - 1)))[:-1]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(first, counts) + inner
        self.row, self.doc, self.start = np.repeat(x.row[pieces], counts), np.repeat(x.doc[pieces], counts), np.repeat(x.begin[pieces], counts) + inner
        hashes = []
        for base in (_GRAM_BASE, _PIECE_BASE):
            sums, down = prefix_sums(byte_values(data), base)
            hashes.append(mix((sums[at + width] - sums[at]) * down[at]))
        order = np.lexsort((self.start, self.doc, hashes[1], hashes[0]))
        a, b = hashes[0][order], hashes[1][order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
        self.first, self.one, self.two = order[new], a[new], b[new]
        self.group = np.zeros(len(a), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """docs with n_bytes, n_removed, removed (spans of bytes) and kept (the bytes left)."""
    carried = others(docs, id_col, text_col, *RESULTS)
    size = B.plan(text_bytes(docs, text_col), block_bytes=4 << 20, bucket_bytes=6 << 20)
    buckets = size.buckets
    parted = B.blocked(docs, id_col, text_col, carried, size.blocks)

    def send(t: pa.Table) -> pa.Table:
        x = Anchors(t, width, gram)
        distinct, times = np.unique(x.anchor[x.firsts()[0]], return_counts=True)
        times = np.minimum(times, 65535).astype("<u2")
        packed = B.pack_values(t.column("__block")[0].as_py(), distinct, buckets)
        return packed.append_column("times", pa.array([times[a:b].tobytes() for _, a, b in B.split(B.bucket_of(distinct, buckets))], pa.binary()))

    def claim(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _packed([])
        x = Anchors(t, width, gram)
        first, _ = x.firsts()
        distinct, at = np.unique(x.anchor[first], return_inverse=True)
        block = t.column("__block")[0].as_py()
        chosen = np.flatnonzero(B.unpack_bits(distinct, buckets, answers.select(["bucket", "bits"]))[at])  # numbers of distinct pieces
        f = first[chosen]
        w = SingleWindows(x, first[_hot(distinct, buckets, answers)[at]], width)
        anchor = np.concatenate((x.anchor[f], w.one))
        columns = (
            anchor.astype("<u8"),
            np.concatenate((chosen, -1 - np.arange(len(w.one)))).astype("<i4"),  # single windows count from -1 down
            np.concatenate((x.doc[f], w.doc[w.first])).astype("<i8"),
            np.concatenate((x.begin[f], w.start[w.first])).astype("<i8"),
            np.concatenate((x.piece[f], w.two)).astype("<u8"),
            np.concatenate((x.count[f] + width - 1, np.zeros(len(w.one), dtype=np.int64))).astype("<u4"),
        )
        at = np.argsort(B.bucket_of(anchor, buckets), kind="stable")
        rows = []
        for k, a, b in B.split(B.bucket_of(anchor, buckets)[at]):
            mine = at[a:b]
            rows.append((k, block, *(c[mine].tobytes() for c in columns), b"".join([x.bytes_of(q, width) for q in f[mine[mine < len(f)]].tolist()])))
        return _packed(rows)

    def settle(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in _PACKED}
        anchor, entry, doc, begin, piece, size = (np.frombuffer(b"".join(cols[c]), kind) for c, kind in (("anchor", "<u8"), ("entry", "<i4"), ("doc", "<i8"), ("begin", "<i8"), ("piece", "<u8"), ("size", "<u4")))
        block = np.repeat(np.array(t.column("__block").to_pylist(), dtype=np.int64), [len(e) // 4 for e in cols["entry"]])
        held, ends = b"".join(cols["bytes"]), np.cumsum(size.astype(np.int64))
        order = np.lexsort((begin, doc, piece, anchor))
        a, p = anchor[order], piece[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))
        number = np.cumsum(new) - 1
        leads = order[new]
        first = leads[number]
        earliest = (doc[order] == doc[first]) & (begin[order] == begin[first])
        later, masks = order[~earliest], []
        # Pieces of anchors that have several; equal windows have equal anchors, so many anchors can be sorted as one string.
        whole = np.flatnonzero(size[leads] > 0)
        own = anchor[leads[whole]]
        multi = whole[B.in_several(own)]
        runs = np.concatenate(([0], np.flatnonzero(np.diff(anchor[leads[multi]])) + 1, [len(multi)])).tolist() if len(multi) else [0]
        heads = np.flatnonzero(new)
        tails = np.concatenate((heads[1:], [len(order)]))
        at = 0
        while at < len(runs) - 1:
            upto, taken = at, 0
            while upto < len(runs) - 1 and (upto == at or taken < SORTED_BYTES):
                taken += (runs[upto + 1] - runs[upto]) * 2 * width
                upto += 1
            these = multi[runs[at] : runs[upto]]
            k = leads[these]
            marked, _, _ = mark([held[e - n : e] for e, n in zip(ends[k].tolist(), size[k].tolist(), strict=True)], doc[k], begin[k], width)
            for i, m in zip(these.tolist(), marked, strict=True):
                if m.any():
                    bits = np.packbits(m).tobytes()
                    masks += [(int(block[q]), int(entry[q]), bits) for q in order[heads[i] : tails[i]][earliest[heads[i] : tails[i]]].tolist()]
            at = upto
        by = later[np.argsort(block[later], kind="stable")]
        rows = [(b, entry[by[x:y]].astype("<i4").tobytes(), None, None) for b, x, y in B.split(block[by])] + [(b, None, e, m) for b, e, m in masks]
        return _answer([(b, l, e, m, None, None) for b, l, e, m in rows])

    schema = T.StructType([parted.schema["__row"], T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType()), *_MADE])

    def remove(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        x = Anchors(t, width, gram)
        first, group = x.firsts()
        told = np.concatenate([np.frombuffer(e, "<i4") for e in answers.column("later").to_pylist() if e is not None] or [np.zeros(0, "<i4")])
        masks = {e: m for e, m in zip(answers.column("entry").to_pylist(), answers.column("mask").to_pylist(), strict=True) if e is not None}
        gone = np.zeros(len(first), dtype=bool)
        gone[told[told >= 0]] = True
        lead = first[group] if len(group) else group
        whole = gone[group] | (x.doc != x.doc[lead]) | (x.begin != x.begin[lead])  # not the first of all with this content
        cover = [np.zeros(len(b) + 1, dtype=np.int32) for b in x.texts]

        def remove_windows(row: int, starts: np.ndarray) -> None:
            np.add.at(cover[row], starts, 1)
            np.add.at(cover[row], starts + width, -1)

        for k in np.flatnonzero(whole).tolist():
            c = cover[x.row[k]]
            c[x.begin[k]] += 1
            c[x.begin[k] + x.count[k] - 1 + width] -= 1
        for k in np.flatnonzero(~whole & np.isin(group, np.fromiter(masks, dtype=np.int64, count=len(masks)))).tolist():
            remove_windows(x.row[k], np.flatnonzero(np.unpackbits(np.frombuffer(masks[int(group[k])], dtype=np.uint8), count=int(x.count[k]))) + x.begin[k])
        if answers.column("hot").null_count < answers.num_rows:
            distinct, at = np.unique(x.anchor[first], return_inverse=True)
            is_hot = _hot(distinct, buckets, answers)[at]
            w = SingleWindows(x, np.flatnonzero(is_hot[group] & ~whole), width)
            single = np.zeros(len(w.one), dtype=bool)
            single[-1 - told[told < 0]] = True
            f = w.first[w.group]
            late = single[w.group] | (w.doc != w.doc[f]) | (w.start != w.start[f])
            for row, a, b in B.split(w.row[late]):
                remove_windows(row, w.start[late][a:b])
        made = []
        for text, c in zip(x.texts, cover, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(c)[:-1] > 0).view(np.int8), [0])))).tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *edge[1::2]], [*edge[0::2], len(text)], strict=True))
            made.append({"n_bytes": len(text), "n_removed": len(text) - len(kept), "removed": [{"begin": a, "end": b} for a, b in zip(edge[0::2], edge[1::2], strict=True)], "kept": kept})
        new = pa.Table.from_pylist(made, schema=_ARROW)
        return pa.table({**{c: x.table.column(c) for c in ("__row", "__id", "__text")}, **{n: new.column(n) for n in _ARROW.names}})

    # All readers of the documents share one exchange by block, the readers of the counts one by bucket.
    counted = parted.groupBy("__block").applyInArrow(lean(send), B.PACKED_SCHEMA + ", times binary").groupBy("bucket").applyInArrow(lean(lambda t: _anchor_counts(t, together)), B.SHARED_SCHEMA + ", hot binary")
    claims = parted.groupBy("__block").cogroup(counted.groupBy("__block")).applyInArrow(lean(claim), "bucket int, __block int, " + ", ".join(f"{c} binary" for c in _PACKED))
    later = claims.groupBy("bucket").applyInArrow(lean(settle), _ANSWER)
    hot = counted.where("hot is not null").select("__block", *(F.lit(None).cast(k).alias(c) for c, k in (("later", "binary"), ("entry", "int"), ("mask", "binary"))), "bucket", "hot")
    out = parted.groupBy("__block").cogroup(later.union(hot).groupBy("__block")).applyInArrow(lean(remove), schema)
    return out.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), *(F.col("__row")[c].alias(c) for c in carried), F.col("__text").alias(text_col), *(F.col(c) for c in RESULTS))


_PACKED = ("anchor", "entry", "doc", "begin", "piece", "size", "bytes")


def _packed(rows: list[tuple]) -> pa.Table:
    """One row for each bucket of a block: numbers and contents of its pieces, one behind the other; single windows have size 0."""
    kinds = (("bucket", pa.int32()), ("__block", pa.int32()), *((c, pa.binary()) for c in _PACKED))
    return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(kinds)})


_ANSWER = "__block int, later binary, entry int, mask binary, bucket int, hot binary"


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = (("__block", pa.int32()), ("later", pa.binary()), ("entry", pa.int32()), ("mask", pa.binary()), ("bucket", pa.int32()), ("hot", pa.binary()))
    return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(kinds)})


def _hot(distinct: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    some = answers.filter(answers.column("hot").is_valid())
    return B.unpack_bits(distinct, buckets, pa.table({"bucket": some.column("bucket"), "bits": some.column("hot")}))


_ARROW = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
