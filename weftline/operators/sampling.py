"""Stratified random samples of sentences, for words with several senses.

Randomness is a hash of a seed and the row's key, so a sample is the same on every run, on any
partitioning, after any retry. Bounded ranks (row_number <= k) keep only k rows a group before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(seed: int, *keys: str) -> Column:
    """A reproducible random key: hexadecimal, compared as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def polysemous(mentions: DataFrame, at_least: int = 2) -> DataFrame:
    """(word) with that many different targets."""
    return mentions.groupBy("word").agg(F.count_distinct("target").alias("n")).where(F.col("n") >= at_least).select("word")


def top_senses(mentions: DataFrame, most: int = 10) -> DataFrame:
    """(word, target, cnt): the most frequent targets of each word, ties by target."""
    counts = mentions.groupBy("word", "target").agg(F.count("*").alias("cnt"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("cnt"), "target"))).where(F.col("r") <= most).drop("r")


def sample_per_sense(mentions: DataFrame, key: str = "sid", per_sense: int = 3, seed: int = 42) -> DataFrame:
    """Up to per_sense sentences of each (word, target), drawn before any cut of senses."""
    drawn = mentions.select("word", "target", key).distinct().withColumn("p", priority(seed, "word", "target", key))
    return drawn.withColumn("r", F.row_number().over(Window.partitionBy("word", "target").orderBy(F.desc("p"), key))).where(F.col("r") <= per_sense).select("word", "target", key)


def sample_senses(mentions: DataFrame, key: str = "sid", per_sense: int = 3, most_senses: int = 10, seed: int = 42) -> DataFrame:
    """sample_per_sense for the top senses of words with at least two."""
    drawn = sample_per_sense(mentions, key, per_sense, seed)
    kept = top_senses(mentions, most_senses).join(polysemous(mentions), "word", "left_semi")
    return drawn.join(kept.select("word", "target"), ["word", "target"], "left_semi")


def sample_per_word(mentions: DataFrame, used: DataFrame, key: str = "sid", per_word: int = 5, per_sense: int = 3, most_senses: int = 10, seed: int = 42) -> DataFrame:
    """Up to per_word sentences of each word with at least two senses, out of a reservoir, without the used (word, key).

    The reservoir is large enough (per_word + most_senses x per_sense) to do without the used ones.
    """
    size = per_word + most_senses * per_sense
    drawn = mentions.select("word", key).distinct().join(polysemous(mentions), "word", "left_semi").withColumn("p", priority(seed + 1, "word", key))
    reservoir = drawn.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("p"), key))).where(F.col("r") <= size)
    rest = reservoir.join(used.select("word", key).distinct(), ["word", key], "left_anti")
    return rest.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("p", key))).where(F.col("r") <= per_word).select("word", key)


def random_lines(lines: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, each with equal chance, by a bounded top-k over the random keys."""
    return lines.withColumn("__p", priority(seed, key)).orderBy("__p", key).limit(n).drop("__p")


def counters(mentions: DataFrame, at_least: int = 2, most_senses: int = 10) -> DataFrame:
    """One row for mentions (word, target): link texts, those with several senses, those of them whose rarer senses are cut off."""
    senses = mentions.groupBy("word").agg(F.count_distinct("target").alias("n"))
    return senses.agg(F.count("*").alias("num_link_texts"), F.count_if(F.col("n") >= at_least).alias("num_polysemous_link_texts"), F.count_if(F.col("n") > max(most_senses, at_least - 1)).alias("num_polysemous_link_texts_cutoff"))
