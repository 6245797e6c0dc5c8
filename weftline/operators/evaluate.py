"""Evaluation of sense clusters against link targets, leave-one-fold-out.

Instances are (fold, word, cluster_id or null, gold). What a fold is tested with comes from all other
folds: counts of the others are the counts of all minus its own, so one aggregation serves every
fold and none is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.arrays import once
from weftline.functions.names import strip_fragment


def counted(instances: DataFrame) -> DataFrame:
    """(fold, word, cluster_id, gold, n): equal instances as one row. All that is below takes such rows too, and counts each n times."""
    return instances.groupBy("fold", "word", "cluster_id", "gold").agg(F.count("*").alias("n"))


def _times(rows: DataFrame, condition: Column | None = None) -> Column:
    """How many instances there are, or for how many the condition holds."""
    if "n" not in rows.columns:
        return F.count("*") if condition is None else F.count_if(condition)
    return F.coalesce(F.sum("n" if condition is None else F.when(condition, F.col("n"))), F.lit(0))


def confusion(instances: DataFrame, by: list[str]) -> DataFrame:
    """(by..., gold, cnt)"""
    return instances.groupBy(*by, "gold").agg(_times(instances).alias("cnt"))


def most_frequent(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sense): the gold value with the highest count, the smallest of equals."""
    return counts.groupBy(*by).agg(F.min_by("gold", F.struct(-F.col("cnt"), F.col("gold"))).alias("sense"))


def without_fold(instances: DataFrame, by: list[str]) -> DataFrame:
    """(fold, by..., gold, cnt): for each fold, the counts of all other folds, where above 0."""
    own = confusion(instances, ["fold", *by])
    total = own.groupBy(*by, "gold").agg(F.sum("cnt").alias("cnt"))
    spread = own.select("fold", *by).distinct().join(total, by)  # each fold asks only for what it has
    left = spread.join(own.withColumnRenamed("cnt", "own"), ["fold", *by, "gold"], "left")
    return left.select("fold", *by, "gold", (F.col("cnt") - F.coalesce("own", F.lit(0))).alias("cnt")).where("cnt > 0")


def predictions(instances: DataFrame) -> DataFrame:
    """Instances with baseline (the word's most frequent gold elsewhere) and sense (its cluster's, else the baseline)."""
    base = most_frequent(without_fold(instances, ["word"]), ["fold", "word"]).withColumnRenamed("sense", "baseline")
    clustered = instances.where(F.col("cluster_id").isNotNull())
    by_cluster = most_frequent(without_fold(clustered, ["word", "cluster_id"]), ["fold", "word", "cluster_id"]).withColumnRenamed("sense", "cluster_sense")
    joined = instances.join(base, ["fold", "word"], "left").join(by_cluster, ["fold", "word", "cluster_id"], "left")
    return joined.withColumn("sense", F.coalesce("cluster_sense", "baseline"))


def metrics(predicted: DataFrame) -> DataFrame:
    """One row of counts over predictions."""
    times = lambda condition=None: _times(predicted, condition)
    hit = lambda c: times(F.col(c) == F.col("gold"))
    return predicted.agg(
        times().alias("instances"),
        times(F.col("baseline").isNotNull()).alias("with_baseline"),
        times(F.col("cluster_id").isNotNull()).alias("with_cluster"),
        times(F.col("cluster_sense").isNotNull()).alias("with_cluster_sense"),
        times(F.col("cluster_id").isNotNull() & F.col("cluster_sense").isNull()).alias("cluster_without_sense"),
        hit("baseline").alias("correct_baseline"),
        hit("cluster_sense").alias("correct_cluster"),
        hit("sense").alias("correct"),
        times(F.col("sense").isNotNull() & (F.col("sense") != F.col("gold"))).alias("incorrect"),
        times(F.col("sense").isNull()).alias("unanswered"),
        times(F.col("cluster_sense").isNull() & (F.col("sense") == F.col("gold"))).alias("correct_by_fallback"),
    )


def mapping(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., senses): text of all gold values with their counts, most frequent first: `R:c  R:c`."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("o"), F.col("gold"))))
    return counts.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["gold"], F.lit(":"), (-x["o"]).cast("string"))), "  ").alias("senses"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt into the session's number of partitions; as it is asked for, these are not united by their bytes, which say little of what hash tables over many short rows take."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def choose_cluster(contexts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(iid, cluster_id, score) for contexts (iid, word, feature): the cluster of the word with the largest summed weight of shared features.

    clusters is (word, cluster_id, feature, weight). Instances that share no feature have no row;
    of equal scores the smallest cluster wins. Contexts are dealt by iid, once, where clusters are
    few enough to be broadcast (by a hint, or as measured); words and features may be very frequent.
    Contexts that are dealt by iid already stay where they are: in partitions of the caller's size.
    """
    shared = dealt(contexts, "iid").distinct().join(clusters, ["word", "feature"]).groupBy("iid", "cluster_id").agg(F.sum("weight").alias("score"))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), "cluster_id")))
    return best.where("r = 1").select("iid", "cluster_id", "score")


def head_word(tokens_column: str, begin, end):
    """Lemma of the token with exactly this span; null for several words."""
    same = F.filter(tokens_column, lambda t: (t["begin"] == begin) & (t["end"] == end))
    return F.when(F.size(same) > 0, F.element_at(same, 1)["lemma"])


def context_lemmas(tokens_column: str, target):
    """Distinct lemmas of a sentence but the target's."""
    return F.array_remove(F.array_distinct(F.transform(tokens_column, lambda t: t["lemma"])), target)


def link_instances(sentences: DataFrame, senses: DataFrame, words: DataFrame) -> DataFrame:
    """(iid, fold, word, gold, context): links of sentences (fold, sid, tokens, links) to be judged.

    A link counts if its resource, without a fragment, is one of the senses (resource), and if its
    span is exactly one token whose lemma is one of the words (word). context has the distinct
    lemmas of the sentence but the word itself.
    """
    link = sentences.select("fold", "sid", "tokens", F.posexplode(F.transform("links", lambda l: F.struct(strip_fragment(l["target"]).alias("gold"), head_word("tokens", l["begin"], l["end"]).alias("word")))).alias("pos", "l"))
    # Of the tokens only the context goes on, should one of the joins deal the links out.
    named = link.where("l.word is not null").select(F.concat_ws("#", "sid", "pos").alias("iid"), "fold", "l.word", "l.gold", context_lemmas("tokens", F.col("l.word")).alias("context"))
    named = named.join(senses.select(F.col("resource").alias("gold")).distinct(), "gold", "left_semi").join(words.select("word").distinct(), "word", "left_semi")
    return named.select("iid", "fold", "word", "gold", "context")


def clustered_instances(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    """(iid, fold, word, cluster_id, gold): link_instances with the cluster of their word that suits the context best, null where none does.

    The choice is that of choose_cluster; instances go along, so that they are made once and need no join with their clusters.
    """
    features = instances.select("iid", "fold", "word", "gold", F.explode_outer("context").alias("feature"))
    scores = features.join(clusters, ["word", "feature"], "left").groupBy("iid", "fold", "word", "gold", "cluster_id").agg(F.sum("weight").alias("score"))
    best = F.min_by("cluster_id", F.when(F.col("cluster_id").isNotNull(), F.struct(F.col("score").isNull(), -F.col("score"), F.col("cluster_id"))))
    return scores.groupBy("iid", "fold", "word", "gold").agg(best.alias("cluster_id")).select("iid", "fold", "word", "cluster_id", "gold")


def evaluate(sentences: DataFrame, senses: DataFrame, words: DataFrame, clusters: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.localCheckpoint) -> DataFrame:
    """predictions for the links of sentences, equal ones counted in one row: each fold is tested with what all others teach.

    keep(rows) writes rows and reads them again: predictions use their input several times, which
    would find and judge all links again each time. Clusters are kept too, so that their size is known.
    """
    return predictions(keep(counted(clustered_instances(link_instances(sentences, senses, words), keep(clusters)))))
