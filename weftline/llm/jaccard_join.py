"""N-gram Jaccard join: parity sketches, pigeonhole on their parts, exact verification.

A document is the set of its distinct shingles of `width` words. Two sets A and B with Jaccard
similarity 0.8 or more differ in at most (|A| + |B|) / 9 shingles. The shingles are dealt by hash
over P parts; a part of the sketch is the XOR of its shingles' 64-bit hashes. A shingle in which
two sets differ changes one part, so with at most d differences at least P - d parts agree, and
the pair meets in a join on (size band, part, value). Size bands overlap such that a set and any
partner up to 5/4 its size share one. Parts without shingles agree by accident: they are left out
unless a set has P - d or more of them, in which case it sends those too, so no pair is lost.

Of all parts of a document only the d + 1 rarest count (prefix filter): two documents that agree
in P - d parts have one of these in common, whatever order rarity gives, as long as it is one order
for all. So parts that a passage shared by very many documents fills are used by no document that
has enough parts of its own.

1. Blocks send their sets' keys as packed hashes; buckets answer how many blocks have each key, as
   a binary logarithm.
2. A table of one row a document keeps the d + 1 rarest keys as far as they are shared, a one-hot
   parity sketch for the pair filter (its Hamming distance never exceeds the symmetric difference),
   the set and its signature. Equal sets link to the smallest id at once.
3. First round: each key's members are paired with the smallest one; pairs pass size and sketch
   filters, then whole sets are compared. So a key shared by thousands of near copies costs one
   pair a copy.
4. Further rounds, for keys of three members or more that are not yet in one component: members are
   dealt in tiles of a bounded size, no two tiles of one component are compared, and of the pairs
   that the filters leave each component of a task gives its most similar ones only. Those that are
   links contract components. A round gives eight times as many as the one before; the rounds end
   when none holds a pair back. So a link is never lost, and pairs are linear in members a round.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; null
doc_ids are one document, before all others, with component null where it is the smallest; rows
with equal doc_id are one document whose links are those of any of its rows; an empty table gives
no rows; other columns pass through, those named like a result are replaced. A text may be of any
length: it is read a megabyte at a time, and takes its worker about 60 bytes a shingle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import blocks as B
from weftline.llm.graph import connected_components
from weftline.llm.shared import lean, materialize, others, partitions, pieces, text_bytes
from weftline.llm.wordhash import LOWERED, U, Words, mix, raw

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
TILE, ROWS_A_TASK, BEST = 512, 20_000, 8
RESULTS = ("n_shingles", "component_id")


def bands(most: int) -> np.ndarray:
    """Smallest sizes of the bands; each is 1.4 times the one before, 1 apart at least."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * 1.4)))
    return np.array(out, dtype=np.int64)


def differences(low_next: np.ndarray) -> np.ndarray:
    """The most shingles in which a similar pair can differ whose smaller set is below low_next: (a + 5a/4) / 9."""
    return (low_next - 1) // 4


def parts(d: np.ndarray) -> np.ndarray:
    return np.where(d == 0, 1, d + 1 + (35 * d + 99) // 100)


@dataclass
class Keys:
    """For each key: its row, a number for (row, band), whether its part is blank, and how many of the rarest count."""

    row: np.ndarray
    group: np.ndarray
    key: np.ndarray
    blank: np.ndarray
    most: np.ndarray

    def rarest(self, often: np.ndarray) -> np.ndarray:
        """Which keys are among the `most` rarest of their group: by class, blank parts last, then by key, one order for all documents."""
        order = np.lexsort((self.key, often, self.blank, self.group))
        group = self.group[order]
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else group
        out = np.zeros(len(group), dtype=bool)
        out[order] = np.arange(len(group)) - first < self.most[order]
        return out


class Sets:
    """Distinct shingles of a block's documents, sorted by document and hash."""

    def __init__(self, t: pa.Table, width: int):
        self.table = B.by_id(t)
        self.ids = B.ids(self.table)
        words = Words(raw(self.table.column("__text")), LOWERED)
        at, h = words.windows(width)
        begins = np.concatenate(([0], np.cumsum(np.maximum(words.count - width + 1, 0))))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            h[a:b].sort()
        owners, hashes = [np.repeat(np.arange(len(words.count)), np.diff(begins))], [h]
        for k in range(1, width):
            short = np.flatnonzero(words.count == k)
            owners.append(short)
            hashes.append(mix(words.runs(words.first[short], k) + U(k)))
        own, h = np.concatenate(owners), np.concatenate(hashes)
        order = np.argsort(own, kind="stable")  # runs that are sorted already; those by hash inside each document stay
        own, h = own[order], h[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=bool)
        self.doc, self.hash = own[new], h[new]
        self.n = np.bincount(self.doc, minlength=len(self.ids))
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        sums, xors = np.zeros(len(self.ids), dtype=U), np.zeros(len(self.ids), dtype=U)
        some = self.n > 0
        if some.any():
            sums[some] = np.add.reduceat(mix(self.hash), self.first[:-1][some])
            xors[some] = np.bitwise_xor.reduceat(mix(self.hash ^ U(0xA5A5A5A5A5A5A5A5)), self.first[:-1][some])
        self.signature = np.stack((sums, xors), axis=1)

    def representatives(self) -> np.ndarray:
        """For each row the first row of the block with the same set; -1 for empty sets."""
        if not len(self.ids):
            return np.zeros(0, dtype=np.int64)
        _, first, inverse = np.unique(np.column_stack((self.signature, self.n.astype(U))), axis=0, return_index=True, return_inverse=True)
        return np.where(self.n > 0, first[inverse.ravel()], -1)

    def keys(self, chosen: np.ndarray) -> Keys:
        """A key for each part of the sketches of the chosen rows, in the home band and the band below."""
        low = bands(int(self.n.max(initial=1)) + 1)
        made, groups = [], 0
        home = np.searchsorted(low, self.n, side="right") - 1
        for lower in (0, 1):
            band = home - lower
            mine = chosen & (band >= 0)
            if lower:
                mine &= self.n * 4 <= 5 * (low[np.maximum(home, 0)] - 1)
            if not mine.any():
                continue
            picked = np.flatnonzero(mine)
            d = differences(low[np.minimum(band[picked] + 1, len(low) - 1)])
            p = parts(d)
            base = np.concatenate(([0], np.cumsum(p)))
            number = np.full(len(self.ids), -1)
            number[picked] = np.arange(len(picked))
            on = number[self.doc] >= 0
            owner, h = number[self.doc[on]], self.hash[on]
            slot = base[owner] + (((mix(h ^ U(0x3C6EF372FE94F82A)) >> U(32)) * p[owner].astype(U)) >> U(32)).astype(np.int64)
            held = np.bincount(slot, minlength=base[-1])
            value = np.zeros(base[-1], dtype=U)
            np.bitwise_xor.at(value, slot, h)
            whose = np.repeat(np.arange(len(picked)), p)
            part = np.arange(base[-1]) - base[whose]
            blank = np.add.reduceat((held == 0).astype(np.int64), base[:-1])
            send = (held > 0) | (blank >= p - d)[whose]
            where = mix(band[picked][whose].astype(U) * U(0x9E3779B97F4A7C15) + part.astype(U) + U(1))
            made.append((picked[whose[send]], groups + whose[send], mix(value ^ where ^ (held == 0).astype(U))[send], held[send] == 0, (d + 1)[whose[send]]))
            groups += len(picked)
        none = np.zeros(0, dtype=np.int64)
        return Keys(*(np.concatenate(x) for x in zip(*made, strict=True))) if made else Keys(none, none, none.view(U), none.astype(bool), none)

    def sketch(self, row: int) -> bytes:
        """One-hot parity: bit i is the number of shingles with hash i, modulo 2; a power of two of bits, twice as many as shingles at least."""
        h = mix(self.hash[self.first[row] : self.first[row + 1]] ^ U(0x1F83D9ABFB41BD6B))
        bits = max(64, 2 << int(len(h) - 1).bit_length())
        return np.packbits(np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(sketch: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """Not refuted by sizes or by the sketches' Hamming distance."""
    if DENOMINATOR * min(na, nb) < NUMERATOR * max(na, nb):
        return False
    bits = 8 * min(len(a), len(b))
    x = _fold(int.from_bytes(a, "little"), 8 * len(a), bits) ^ _fold(int.from_bytes(b, "little"), 8 * len(b), bits)
    return 9 * x.bit_count() <= na + nb


@F.pandas_udf(T.BooleanType())
def _may_link(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([may_link(*x) for x in zip(na, nb, a, b, strict=True)], dtype=bool)


def document_sets(parted: DataFrame, size: B.Plan, width: int) -> DataFrame:
    """One row a document: __id, __row, n, rep (smallest id of the block with the same set; null without shingles), again (the id has other rows).

    Representatives have sig1 and sig2, and those with shared keys have keys, sketch and shingles.
    """
    buckets = size.buckets

    def send(t: pa.Table) -> pa.Table:
        s = Sets(t, width)
        rep = s.representatives()
        return B.pack_values(t.column("__block")[0].as_py(), np.unique(s.keys(rep == np.arange(len(rep))).key), buckets)

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([parted.schema["__row"], *(T.StructField(n, T.LongType()) for n in ("__id", "n", "rep", "sig1", "sig2")), T.StructField("again", T.BooleanType()), T.StructField("keys", longs), T.StructField("shingles", longs), T.StructField("sketch", T.BinaryType())])

    def keep(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        s = Sets(t, width)
        rep = s.representatives()
        leads = rep == np.arange(len(rep))
        k = s.keys(leads)
        distinct, inverse = np.unique(k.key, return_inverse=True)
        often = B.unpack_classes(distinct, buckets, answers)[inverse]
        chosen = k.rarest(often)
        times = np.bincount(inverse[chosen], minlength=len(distinct))
        chosen &= (often > 0) | (times > 1)[inverse]
        rows, keys = k.row[chosen], k.key[chosen].view(np.int64)
        order = np.argsort(rows, kind="stable")
        count = np.bincount(rows, minlength=len(rep))
        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        held = np.where(count > 0, s.n, 0)
        _, same, often_id = np.unique(s.ids, return_inverse=True, return_counts=True)
        sig = s.signature.view(np.int64)
        return pa.table(
            {
                "__row": s.table.column("__row"),
                "__id": pa.array(s.ids),
                "n": pa.array(s.n.astype(np.int64)),
                "rep": pa.array(np.where(rep >= 0, s.ids[np.maximum(rep, 0)], 0), mask=rep < 0),
                "sig1": pa.array(sig[:, 0], mask=~leads),
                "sig2": pa.array(sig[:, 1], mask=~leads),
                "again": pa.array(often_id[same] > 1) if len(s.ids) else pa.array([], pa.bool_()),
                "keys": pa.ListArray.from_arrays(ends, keys[order]),
                "shingles": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(held))).astype(np.int32), s.hash[(count > 0)[s.doc]].view(np.int64)),
                "sketch": pa.array([s.sketch(x) if count[x] else None for x in range(len(rep))], pa.binary()),
            }
        )

    counted = parted.groupBy("__block").applyInArrow(lean(send), B.PACKED_SCHEMA).groupBy("bucket").applyInArrow(lean(B.shared_classes), B.CLASSES_SCHEMA)
    return parted.groupBy("__block").cogroup(counted.groupBy("__block")).applyInArrow(lean(keep), schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets (id, shingles) are similar enough."""
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(DENOMINATOR * both >= NUMERATOR * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest one's length."""
    size = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, dtype="<u8").reshape(-1, size // 8), axis=0) for s in sketches])


def _candidates(comp: np.ndarray, tile: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, share of shingles that differ at least) of the pairs across components, and across tiles if there are two, that sizes and sketches leave."""
    rows, two = _folded(sketches), tile[0] != tile[-1]
    found = []
    for i in range(len(comp) - 1):
        later = slice(i + 1, len(comp))
        ok = (comp[later] != comp[i]) & (DENOMINATOR * np.minimum(n[later], n[i]) >= NUMERATOR * np.maximum(n[later], n[i]))
        if two:
            ok &= tile[later] != tile[i]
        j = i + 1 + np.flatnonzero(ok)
        if len(j):
            differ = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64)
            near = 9 * differ <= n[j] + n[i]
            if near.any():
                found.append((np.full(int(near.sum()), i), j[near], differ[near] / (n[j] + n[i])[near]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(ci: np.ndarray, cj: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first `most` (in `order`) of one of their two components."""
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    comp, place, pair = np.concatenate((ci, cj)), np.concatenate((rank, rank)), np.tile(np.arange(len(ci)), 2)
    by = np.lexsort((place, comp))
    c = comp[by]
    new = np.concatenate(([True], c[1:] != c[:-1]))
    among = np.arange(len(c)) - np.flatnonzero(new)[np.cumsum(new) - 1] < most
    out = np.zeros(len(ci), dtype=bool)
    out[pair[by[among]]] = True
    return out


def across(members: DataFrame, label: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) across components among the members (key, id) of each key, the `most` nearest of each component and task.

    A row of nulls stands for pairs held back. A task compares two tiles, or one with itself: a
    component of more than TILE members has tiles of its own, all others of a key share tiles.
    """
    null = F.lit(int(B.NULL_ID))
    placed = members.join(label.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = materialize(placed.groupBy("key", "comp").agg(F.count("*").alias("c")), "jaccard-sizes")
    open_keys = sizes.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.when(F.col("c") <= TILE, F.col("c"))).alias("few")).where("lo <> hi").select("key", "few")
    large = F.col("c") > TILE
    dealt = sizes.join(open_keys, "key").select("key", "comp", F.when(large, F.col("comp")).otherwise(null).alias("own"), large.alias("large"), F.ceil(F.when(large, F.col("c")).otherwise(F.col("few")) / TILE).cast("int").alias("tiles"))
    dealt = materialize(dealt, "jaccard-dealt")
    tiles = dealt.select("key", "own", "large", "tiles").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "own", "large", "tile")
    other = tiles.select("key", F.col("own").alias("own2"), F.col("tile").alias("tile2"))
    pairs = tiles.join(other, "key").where("(own < own2) or (own = own2 and not large and tile <= tile2)")
    pairs = pairs.withColumn("pair", F.xxhash64("key", "own", "tile", "own2", "tile2"))
    sides = pairs.select("key", "own", "tile", "pair").union(pairs.select("key", F.col("own2").alias("own"), F.col("tile2").alias("tile"), "pair")).distinct()
    sides = materialize(sides, "jaccard-tiles")
    spread = F.when(F.col("large"), F.xxhash64("id")).otherwise(F.xxhash64("comp"))
    rows = placed.join(dealt, ["key", "comp"]).withColumn("tile", F.pmod(spread, F.col("tiles")).cast("int")).join(sides, ["key", "own", "tile"]).select("key", "pair", "own", "tile", "id", "comp")
    rows = materialize(rows, "jaccard-rows")
    tasks = max(partitions(members.sparkSession), pieces(rows.count(), ROWS_A_TASK))
    met = rows.withColumn("task", F.pmod(F.xxhash64("pair"), F.lit(tasks)).cast("int")).join(facts, "id")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("pair", "key", "own", "tile", "id")])
        key, pair, own, tile, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "pair", "own", "tile", "id", "comp", "n"))
        sketch = t.column("sketch")
        edge = np.flatnonzero((np.diff(pair) != 0) | (np.diff(key) != 0)) + 1
        found: set[tuple[int, int]] = set()
        back = False
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            here = slice(lo, hi)
            number = np.cumsum(np.concatenate(([0], (np.diff(own[here]) != 0) | (np.diff(tile[here]) != 0))))
            i, j, share = _candidates(comp[here], number, n[here], sketch.slice(lo, hi - lo).to_pylist())
            if len(i):
                a, b = np.minimum(ids[lo + i], ids[lo + j]), np.maximum(ids[lo + i], ids[lo + j])
                take = _best(comp[lo + i], comp[lo + j], np.lexsort((b, a, share)), most)
                back |= not take.all()
                found.update(zip(a[take].tolist(), b[take].tolist(), strict=True))
        rest = [None] * back
        return pa.table({"a": pa.array([a for a, _ in found] + rest, pa.int64()), "b": pa.array([b for _, b in found] + rest, pa.int64())})

    return met.groupBy("task").applyInArrow(lean(run), "a long, b long").distinct()


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, best: int = BEST) -> DataFrame:
    """docs (without their texts) with n_shingles and component_id; `best` pairs of a component and task at most are tried in the first of the further rounds."""
    carried = others(docs, id_col, text_col, *RESULTS)
    size = B.plan(text_bytes(docs, text_col))
    parted = B.blocked(docs, id_col, text_col, carried, size.blocks)
    sets = materialize(document_sets(parted, size, width), "jaccard-sets")

    leads = sets.where(F.col("sig1").isNotNull())
    alike = leads.where("n > 0").select("__id", "n", "sig1", "sig2")
    equal = alike.groupBy("n", "sig1", "sig2").agg(F.min("__id").alias("m"), F.max("__id").alias("z")).where("m <> z").select("n", "sig1", "sig2", "m")
    same_set = materialize(alike.join(equal, ["n", "sig1", "sig2"]).where("__id <> m").select(F.col("__id").alias("a"), F.col("m").alias("b")), "jaccard-equal")
    same_id = sets.where("again and rep <> __id").select(F.col("__id").alias("a"), F.col("rep").alias("b"))
    # Of equal sets one goes on; an id with other rows goes on for their sake.
    first_of = leads.where(F.col("sketch").isNotNull()).select(F.col("__id").alias("id"), "n", "sig1", "keys", "sketch", "shingles", "again")
    first_of = first_of.join(same_set.select(F.col("a").alias("id"), F.lit(True).alias("later")).distinct(), "id", "left").where("again or later is null")
    members = first_of.select(F.explode("keys").alias("key"), "id").distinct()
    facts, whole = first_of.select("id", "n", "sketch"), first_of.select("id", "shingles")
    hubs = materialize(members.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1"), "jaccard-hubs")
    pairs = members.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    left, right = (facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = pairs.join(left, "a").join(right, "b").where(f"{DENOMINATOR} * least(na, nb) >= {NUMERATOR} * greatest(na, nb)").where(_may_link("na", "nb", "sa", "sb")).select("a", "b").distinct()
    tested = materialize(near, "jaccard-pairs")
    label = connected_components(verified(tested, whole).union(same_set).union(same_id), "jaccard")

    # Keys of two members have had their pair.
    several = materialize(members.join(hubs.where("c > 2"), "key").select("key", "id"), "jaccard-members")
    while True:
        told = materialize(across(several, label, facts, best), "jaccard-across")
        fresh = materialize(told.where("a is not null").join(tested, ["a", "b"], "left_anti"), "jaccard-fresh")
        label = connected_components(label.toDF("a", "b").union(verified(fresh, whole)), "jaccard")
        if not told.where("a is null").count():
            break
        tested, best = tested.union(fresh), 8 * best
    null = F.lit(int(B.NULL_ID))
    out = sets.withColumn("__at", F.coalesce("rep", "__id")).join(label, F.col("__at") == label["u"], "left").withColumn("comp", F.coalesce("v", "__at"))
    back = docs.schema[id_col].dataType
    return out.select(F.when(F.col("__id") != null, F.col("__id")).cast(back).alias(id_col), *(F.col("__row")[c].alias(c) for c in carried), F.col("n").alias("n_shingles"), F.when(F.col("comp") != null, F.col("comp")).alias("component_id"))
