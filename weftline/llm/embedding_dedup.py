"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised in double precision; equal vectors collapse to one with a multiplicity.
Each of `tables` tables hashes a unit vector to the floors of `projections` Gaussian projections
in steps of `step`; cosine 0.95 is a distance of 0.316, for which a projection agrees with
probability 0.83. Vectors that share a bucket of a table are compared exactly. A pair counts in
the first table in which it meets, so links are counted once without ever being listed; what
leaves a task is a count for each vector and a spanning forest of the links found there.

The number of projections follows the number of distinct vectors, so that a bucket of unrelated
vectors keeps its size, and the number of tables follows the projections, so that a pair at
cosine 0.95 is met with probability `recall` (0.98). A bucket with more than `tile` vectors is
dealt in pairs of tiles: no task holds more than two tiles of a bucket at a time.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with
nothing, and neither do vectors of different length with each other; equal vectors always link,
so a vector of multiplicity m has m - 1 links at least; null vec_ids are one id, before all
others (component null where it is the smallest); an empty table gives no rows; other columns
pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.blocks import NULL_ID
from weftline.llm.graph import connected_components
from weftline.llm.shared import lean, materialize, others, partitions, pieces, quoted

THRESHOLD, STEP, RECALL, TILE, ROWS_A_TASK = 0.95, 1.5, 0.98, 1024, 20_000
RESULTS = ("n_links", "component_id", "kept")


def agreement(distance: float, step: float) -> float:
    """Probability that one quantised Gaussian projection is equal for two points at a distance."""
    r = step / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float, step: float, recall: float) -> tuple[int, int]:
    """(projections, tables) for n distinct vectors: about 16 unrelated vectors to a bucket; recall at the threshold."""
    far = agreement(math.sqrt(2), step)
    projections = max(6, math.ceil(math.log(max(n, 1) / 16 + 1) / -math.log(far)))
    near = agreement(math.sqrt(2 - 2 * threshold), step) ** projections
    return projections, max(4, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def packed_vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """The components of each vector that can link, in the input's precision; None for all others."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        packed = None
        if v is not None and len(v) and None not in v:
            x = np.array(v, dtype=kind)
            if np.isfinite(x).all() and x.any():
                packed = x.tobytes()
        out.append(packed)
    return out


def unit(packed: bytes, kind: str) -> np.ndarray:
    """Length 1 in double precision; divided by its largest component first, so that no square over- or underflows."""
    x = np.frombuffer(packed, kind).astype(np.float64)
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, step: float = STEP, recall: float = RECALL, tile: int = TILE, seed: int = 77) -> DataFrame:
    """vectors (without the vector column) with n_links, component_id and kept."""
    spark = vectors.sparkSession
    carried = others(vectors, id_col, vector_col, *RESULTS)
    null = F.lit(int(NULL_ID))
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"

    def normal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed_vectors(batch.column("v"), kind), pa.binary())], names=["id", "vec"])

    units = vectors.select(F.coalesce(F.col(quoted(id_col)).cast("long"), null).alias("id"), F.col(quoted(vector_col)).cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).mapInArrow(lean(normal), "id long, vec binary")
    units = materialize(units, "embed-units")
    linkable = units.where(F.col("vec").isNotNull())
    distinct = materialize(linkable.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "embed-distinct")
    equal = linkable.join(distinct, "vec").select("id", "rep", "m")
    n = distinct.count()
    projections, tables = shape(n, threshold, step, recall)
    tasks = max(partitions(spark), pieces(n * tables, ROWS_A_TASK))

    def signatures(batches):
        """bucket numbers of each vector in all tables; hyperplanes are drawn anew for each length of vectors."""
        planes: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            for u in batch.column("vec").to_pylist():
                x = unit(u, kind)
                if len(x) not in planes:
                    rng = np.random.default_rng([seed, len(x)])
                    planes[len(x)] = (rng.normal(size=(len(x), tables * projections)), rng.uniform(0, step, tables * projections), rng.integers(1, 2**63, tables * projections, dtype=np.int64) | 1)
                a, b, odd = planes[len(x)]
                q = np.floor((x @ a + b) / step).astype(np.int64)
                with np.errstate(over="ignore"):
                    h = (((q + 1000003) * odd) ^ ((q * odd) >> 29)).reshape(tables, projections).sum(1)
                rows.append((h ^ np.int64(len(x))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    signed = materialize(distinct.mapInArrow(lean(signatures), "vec binary, rep long, m long, buckets array<long>"), "embed-buckets")
    spread = signed.select("rep", "m", "vec", "buckets", F.posexplode("buckets").alias("t", "bucket")).withColumn("buckets", F.slice("buckets", 1, F.col("t")))
    sizes = signed.select(F.posexplode("buckets").alias("t", "bucket")).groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    sizes = materialize(sizes, "embed-sizes")  # a plain exchange, so that the join may split a bucket with very many vectors
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    met = spread.join(sizes, ["t", "bucket"]).withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other")).withColumn("task", F.pmod(F.xxhash64("t", "bucket", "x", "y"), F.lit(tasks)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        keys = list(zip(*(t.column(c).to_pylist() for c in ("t", "bucket", "x", "y")), strict=True))
        rep, m, mine = (t.column(c).to_numpy() for c in ("rep", "m", "tile"))
        units, signs = [unit(u, kind) for u in t.column("vec").to_pylist()], t.column("buckets").combine_chunks()
        groups: dict[tuple, list[int]] = {}
        for k, g in enumerate(keys):
            groups.setdefault(g, []).append(k)
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for (table, _, x, y), rows in groups.items():
            rows = np.array(rows)
            size = len(units[rows[0]])
            rows = rows[[len(units[r]) == size for r in rows]]
            v = np.stack([units[r] for r in rows])
            b = np.array([signs[int(r)].as_py() for r in rows]).reshape(len(rows), table)  # in the tables before this one
            root = np.arange(len(rows))

            def find(i: int, root=root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in range(len(rows) - 1):
                near = i + 1 + np.flatnonzero(v[i + 1 :] @ v[i] >= threshold)
                if x != y:  # pairs inside a tile belong to that tile's own task
                    near = near[mine[rows[near]] != mine[rows[i]]]
                if len(near) and table:
                    near = near[~(b[near] == b[i]).any(axis=1)]
                for j in near.tolist():
                    p, q = int(rep[rows[i]]), int(rep[rows[j]])
                    links[p] = links.get(p, 0) + int(m[rows[j]])
                    links[q] = links.get(q, 0) + int(m[rows[i]])
                    a, c = find(i), find(j)
                    if a != c:
                        root[c] = a
                        edges.append((p, q))
        return pa.table({"a": pa.array([*links, *(p for p, _ in edges)], pa.int64()), "b": pa.array([None] * len(links) + [q for _, q in edges], pa.int64()), "n": pa.array([*links.values(), *[0] * len(edges)], pa.int64())})

    found = materialize(met.groupBy("task").applyInArrow(lean(compare), "a long, b long, n long"), "embed-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    label = connected_components(found.where("b is not null").select("a", "b"), "embed")
    placed = equal.join(counts, equal["rep"] == counts["a"], "left").join(label, equal["rep"] == label["u"], "left").select("id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("v", "rep").alias("comp"))
    whole = vectors.select(F.coalesce(F.col(quoted(id_col)).cast("long"), null).alias("__id"), (F.struct(*(F.col(quoted(c)).alias(c) for c in carried)) if carried else F.lit(None)).alias("__row"))
    placed = placed.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("comp").alias("comp"))
    out = whole.join(placed, whole["__id"] == placed["id"], "left").withColumn("comp", F.coalesce("comp", "__id"))
    back = vectors.schema[id_col].dataType
    return out.select(F.when(F.col("__id") != null, F.col("__id")).cast(back).alias(id_col), *(F.col("__row")[c].alias(c) for c in carried), F.coalesce("n_links", F.lit(0)).cast(T.LongType()).alias("n_links"), F.when(F.col("comp") != null, F.col("comp")).alias("component_id"), (F.col("comp") == F.col("__id")).alias("kept"))
