"""Filters by word lists, frequencies and surface texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.codec import LEMMA_END
from weftline.functions.names import starts_lower


def whitelisted(mentions: DataFrame, words: list[str]) -> DataFrame:
    """Mentions whose lemma, or lemma@@target, is one of the words of a setting."""
    return mentions.where(F.col("lemma").isin(words) | F.concat("lemma", F.lit(LEMMA_END), "target").isin(words))


def whitelisted_by(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """The same against a table (word) of any size: two semi joins on equality, no condition with OR."""
    keyed = mentions.withColumn("__sense", F.concat("lemma", F.lit(LEMMA_END), "target"))
    plain, sense = words.where(F.instr("word", LEMMA_END) == 0), words.where(F.instr("word", LEMMA_END) > 0)
    by_word = keyed.join(plain.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_semi")
    by_sense = keyed.join(plain.select(F.col("word").alias("lemma")), "lemma", "left_anti").join(sense.select(F.col("word").alias("__sense")), "__sense", "left_semi")
    return by_word.unionByName(by_sense).select(*mentions.columns)


def by_surface_text(links: DataFrame, words: DataFrame) -> DataFrame:
    """(sid, sentence, links) with the links whose text in the sentence is a word (word); sentences left without go."""
    one = links.select("sid", "sentence", F.posexplode("links").alias("pos", "l"))
    one = one.withColumn("word", F.substr("sentence", F.col("l.begin") + 1, F.col("l.end") - F.col("l.begin"))).join(words.select("word").distinct(), "word", "left_semi")
    return one.groupBy("sid", "sentence").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]).alias("links"))


def mid_frequency(words: DataFrame, min_freq: int, top_cutoff: int) -> DataFrame:
    """Words (word, cnt) of min_freq or more without the top_cutoff most frequent ones (ties by word).

    The top is found as a bounded top-k and taken away by an anti join; no total order of all words is made.
    """
    enough = words.where(F.col("cnt") >= min_freq)
    top = enough.orderBy(F.desc("cnt"), "word").limit(top_cutoff)
    return enough.join(top.select("word"), "word", "left_anti")


def samples_of(samples: DataFrame, words: DataFrame) -> DataFrame:
    """Samples (word, ...) whose word, up to @@, is one of the words."""
    keyed = samples.withColumn("__word", F.substring_index("word", LEMMA_END, 1))
    return keyed.join(words.select(F.col("word").alias("__word")), "__word", "left_semi").drop("__word")


def word_list_slice(words: DataFrame, offset: int, limit: int) -> DataFrame:
    """The first `limit` words with a lower-case initial and no blank beyond the first `offset` rows, in order of (cnt desc, word).

    The offset counts all words (word, cnt; each once), the limit only those that pass. Both ends are
    bounded top-k's; no total order of all words is made.
    """
    order = [F.desc("cnt"), F.asc("word")]
    rest = words.join(words.orderBy(*order).limit(offset), ["word", "cnt"], "left_anti") if offset else words
    # The join names the count, so that it does not move below the counting, where it would meet every occurrence of a word.
    return rest.where(starts_lower(F.col("word"))).orderBy(*order).limit(limit).select(*words.columns)


def first_per_key(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")


def within_lengths(sentences: DataFrame, most: int, column: str = "text") -> DataFrame:
    return sentences.where(F.length(column) <= most)

