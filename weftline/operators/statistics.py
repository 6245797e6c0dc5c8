"""Link statistics: inlinks, histograms, surface forms of resources, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import strip_fragment
from weftline.operators.redirects import resolve


def inlink_counts(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """(resource, cnt) of links (target), each target resolved."""
    return resolve(links, redirects, into="resource").groupBy("resource").agg(F.count("*").alias("cnt"))


def existing(links: DataFrame, pages: DataFrame, column: str = "resource") -> DataFrame:
    """Rows whose resource is a page."""
    return links.join(pages.select(F.col("resource").alias(column)), column, "left_semi")


def histogram(counts: DataFrame) -> DataFrame:
    """(cnt, n): how many rows have each count."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n"))


def histogram_with_zero(counts: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """The histogram, and how many pages that are no redirects have no count at all: pages - redirects - counted.

    The row for 0 is always there; it is negative if redirects are missing from the pages.
    """
    zero = pages.agg(F.count_distinct("resource").alias("p")).crossJoin(redirects.agg(F.count_distinct("source").alias("r"))).crossJoin(counts.agg(F.count("*").alias("c")))  # one row each
    return histogram(counts.where("cnt <> 0")).unionByName(zero.select(F.lit(0).cast("bigint").alias("cnt"), (F.col("p") - F.col("r") - F.col("c")).alias("n")))


def link_text_counts(mentions: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """(resource, link_text, cnt) of mentions (link_text, target) that lead to a page."""
    found = existing(resolve(mentions, redirects, into="resource"), pages)
    return found.groupBy("resource", "link_text").agg(F.count("*").alias("cnt"))


def surface_forms_per_resource(text_counts: DataFrame) -> DataFrame:
    """(resource, cnt, distinct_forms): cnt sums occurrences, distinct_forms counts different texts."""
    return text_counts.groupBy("resource").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("distinct_forms"))


def redirect_counts(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """(resource, cnt): redirects that lead to each page, fragments left out."""
    led = redirects.select(strip_fragment(F.col("destination")).alias("resource"))
    return existing(led, pages).groupBy("resource").agg(F.count("*").alias("cnt"))


def counters(mentions: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: links, pages, redirects, linked resources, linked pages, link texts, link texts with several targets."""
    resolved = resolve(mentions, redirects, into="resource")
    held = pages.select(F.col("resource"), F.lit(1).alias("is_page")).distinct()
    one = resolved.join(held, "resource", "left")
    texts = one.groupBy("link_text").agg(F.count("*").alias("links"), F.count_distinct("resource").alias("targets"))
    by_text = texts.agg(F.sum("links").alias("num_links"), F.count("*").alias("num_link_texts"), F.count_if(F.col("targets") >= 2).alias("num_polysemous_link_texts"))
    by_resource = one.agg(F.count_distinct("resource").alias("num_linked_resources"), F.count_distinct(F.when(F.col("is_page") == 1, F.col("resource"))).alias("num_linked_pages"))
    return by_text.crossJoin(by_resource).crossJoin(pages.agg(F.count_distinct("resource").alias("num_pages"))).crossJoin(redirects.agg(F.count_distinct("source").alias("num_redirects")))  # one row each


def noun_link_counters(sentences: DataFrame) -> DataFrame:
    """One row for sentences (tokens, links): num_links; num_tokens, those looked at, for each link up to the noun that has its very span, all if none has; num_noun_links."""
    exact = lambda t, l: (t["begin"] == l["begin"]) & (t["end"] == l["end"]) & t["pos"].isin("NN", "NNS")
    place = F.array_position(F.transform("tokens", lambda t: exact(t, F.col("l"))), F.lit(True))
    each = sentences.select("tokens", F.explode("links").alias("l")).select(place.alias("p"), F.size("tokens").alias("n"))
    return each.agg(F.count("*").alias("num_links"), F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("n")).cast("bigint")), F.lit(0)).alias("num_tokens"), F.count_if(F.col("p") > 0).alias("num_noun_links"))
