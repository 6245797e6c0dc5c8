"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round writes its links to the shared folder and rereads them, so that no lineage grows.
Links are pairs of longs; the component of a node is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import materialize


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(links: DataFrame, tag: str) -> DataFrame:
    """(u, v): v is the component of u; nodes that are their own component's smallest have no row.

    What a node's links are joined with is written first, so that both sides of each join are plain
    exchanges, and the engine may split the partition of a node with very many links.
    """
    e = links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, f"{tag}-links")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        e = materialize(small, f"{tag}-links")
        after = _state(e)
        if after == before:
            break
        before = after
    return e
