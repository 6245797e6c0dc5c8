"""Redirects: one hop from a page's name to the page it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import redirected, strip_fragment


def resolve(links: DataFrame, redirects: DataFrame, keep_fragment: bool = False, target: str = "target", into: str = "resolved") -> DataFrame:
    """links with `into`: target's page after at most one redirect, found under the target without its fragment.

    redirects (source, destination) has one row a source; see `one_each`. Whether the join
    broadcasts is left to the optimiser, which knows the size.
    """
    told = redirects.select(F.col("source").alias("__source"), F.col("destination").alias("__destination"))
    joined = links.join(told, strip_fragment(F.col(target)) == F.col("__source"), "left")
    return joined.withColumn(into, redirected(F.col(target), F.col("__destination"), keep_fragment)).drop("__source", "__destination")


def resolve_verbatim(links: DataFrame, redirects: DataFrame, target: str = "target", into: str = "resolved") -> DataFrame:
    """As resolve, but the target is looked up as it stands and a redirect is taken whole."""
    told = redirects.select(F.col("source").alias("__source"), F.col("destination").alias("__destination"))
    joined = links.join(told, F.col(target) == F.col("__source"), "left")
    return joined.withColumn(into, F.coalesce("__destination", target)).drop("__source", "__destination")


def one_each(redirects: DataFrame) -> DataFrame:
    """One destination a source: the smallest."""
    return redirects.groupBy("source").agg(F.min("destination").alias("destination"))
