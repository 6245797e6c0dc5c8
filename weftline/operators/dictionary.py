"""Dictionaries of surface forms and their senses, from mentions (lemma, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.arrays import once


def surface_form_counts(mentions: DataFrame) -> DataFrame:
    """(lemma, target, cnt): how often each lemma stands for each target."""
    return mentions.groupBy("lemma", "target").agg(F.count("*").alias("cnt"))


def lemma_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.col("lemma").alias("word")).agg(F.count("*").alias("cnt"))


def sense_inventory(counts: DataFrame, min_share: int | None = None) -> DataFrame:
    """(lemma, total, num_senses, targets): the senses of each lemma, most frequent first, ties by target.

    With min_share = 10, senses below a tenth of the total (rounded down) are left out of
    num_senses and targets, while total still has them; a lemma may be left with none. Only
    surviving senses are collected, so a lemma's list is then at most 10 long (or its total is
    below 10). The window and the grouping share one exchange by lemma.
    """
    kept = F.lit(True)
    if min_share:
        counts = counts.withColumn("__total", F.sum("cnt").over(Window.partitionBy("lemma")))
        kept = F.col("cnt") >= F.expr(f"__total div {min_share}")
    sense = F.when(kept, F.struct((-F.col("cnt")).alias("order"), "target", "cnt"))
    found = counts.groupBy("lemma").agg(F.sum("cnt").alias("total"), F.count_if(kept).alias("num_senses"), F.sort_array(F.collect_list(sense)).alias("s"))
    return found.select("lemma", "total", "num_senses", F.transform("s", lambda x: F.struct(x["target"].alias("target"), x["cnt"].alias("cnt"))).alias("targets"))


def explode_mentions(links: DataFrame) -> DataFrame:
    """(sentence, lemma, target, begin, end, pos) of links (sentence, links); pos is the place in the list."""
    return links.select("sentence", F.posexplode("links").alias("pos", "l")).select("sentence", "l.lemma", "l.target", "l.begin", "l.end", "pos")


def noun_link_lemmas(sentences: DataFrame) -> DataFrame:
    """(lemma, target, begin, end) of links whose span is exactly one noun (sentence, tokens, links).

    Tokens and links of a sentence stand in one row, so the span join is a filter of arrays.
    """
    link = sentences.select("*", F.explode("links").alias("l"))
    noun = F.filter("tokens", lambda t: (t["begin"] == F.col("l.begin")) & (t["end"] == F.col("l.end")) & t["pos"].isin("NN", "NNS"))
    return link.select("sentence", "l", F.explode(F.slice(noun, 1, 1)).alias("noun")).select("sentence", "noun.lemma", "l.target", "l.begin", "l.end")


def lemmatize_links(sentences: DataFrame, redirects: DataFrame) -> DataFrame:
    """(sentence, links): links that cover exactly one token, a noun, with its lemma, their targets resolved by one redirect.

    The redirect is looked up under the target as it stands, fragment included. Sentences left
    without links are dropped. sentences need an id column `sid`. Few redirects should come with a
    broadcast hint: dealt by target, all links to one target meet in one task if the optimiser takes
    the redirects for small only when they are dealt already. Of the sentences, only ids and links
    are dealt by id, and texts where the caller keeps them.
    """
    link = sentences.select("sid", "sentence", "tokens", F.posexplode("links").alias("pos", "l"))
    covered = F.filter("tokens", lambda t: (t["begin"] >= F.col("l.begin")) & (t["end"] <= F.col("l.end")))
    one = link.select("sid", "sentence", "pos", "l", once(covered).alias("c")).where(F.size("c") == 1).select("sid", "sentence", "pos", "l", F.get("c", F.lit(0)).alias("t")).where(F.col("t.pos").isin("NN", "NNS"))
    led = one.join(redirects, one["l.target"] == redirects["source"], "left")
    made = F.struct(F.col("pos"), F.col("t.lemma").alias("lemma"), F.coalesce("destination", "l.target").alias("target"), F.col("l.begin").alias("begin"), F.col("l.end").alias("end"))
    grouped = led.groupBy("sid", F.xxhash64("sentence").alias("h")).agg(F.first("sentence").alias("sentence"), F.sort_array(F.collect_list(made)).alias("s"))
    return grouped.select("sid", "sentence", F.transform("s", lambda x: x.dropFields("pos")).alias("links"))
