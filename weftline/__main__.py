"""Commands: python -m weftline COMMAND ARGUMENTS, or the same through spark-submit.

process DUMP OUT                          pages, redirects, sentences, links, implicitlinks of a dump
lemmatize LINKS OUT [REDIRECTS]           single-noun links with lemmas, targets resolved
tokenize INSTANCES OUT                    lemma, target, token lemmas of each instance
whitelist LINKS OUT WORDS                 links whose lemma, or lemma@@target, is in a comma-separated list
wordcount LINKS OUT                       noun lemmas by frequency
dictionary LINKS OUT                      lemma@@target and count
senses DICTIONARY OUT [SHARE]             senses of each lemma; SHARE 10 leaves out senses below a tenth
sample LINKS OUT                          random sentences by word and sense
inlinks MENTIONS OUT [REDIRECTS]          histogram of inlink counts
statistics MENTIONS PAGES REDIRECTS OUT   inlinks, surface forms, redirects, with histograms
bytext LINKS OUT WORDFILE                 links whose text is in a word list
first LINKS OUT [N]                       the first 100 sentences of each lemma
midfrequency WORDS SAMPLES OUT MIN TOP    samples of words that are neither rare nor among the most frequent
wordlist WORDS OUT OFFSET LIMIT           lower-case words without blanks
evaluate INSTANCES OUT                    leave-one-file-out evaluation; rows are word, cluster, target
lines FILE OUT N                          n random lines
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import PipelineConfig
from weftline.functions import codec, text
from weftline.operators import dictionary as D
from weftline.operators import evaluate, filters, sampling
from weftline.operators import statistics as S
from weftline.sources import readers as R
from weftline.sources import writers as W


def _mentions(links: DataFrame) -> DataFrame:
    return D.explode_mentions(links).where(F.col("lemma").isNotNull())


def _sense(df: DataFrame) -> DataFrame:
    return df.select(F.concat("lemma", F.lit(codec.LEMMA_END), "target").alias("sense"), "cnt")


def process(spark, dump, out):
    W.write_dump(R.xml_pages(spark, dump), out)


def lemmatize(spark, links, out, redirects=None):
    led = R.redirects(spark, redirects or PipelineConfig.of(spark).redirects_file)
    W.write_delimited(D.lemmatize_links(R.tokenized(spark, links), led).select("sentence", "links"), out)


def tokenize(spark, instances, out):
    rows = R.delimited(spark, instances, "lemma", "sentence", "link").withColumn("l", codec.decode_link(F.col("link"))).where(F.col("l").isNotNull())
    lemmas = F.array_join(F.transform(text.tokens(F.col("sentence")), lambda t: t["lemma"]), " ")
    W.write_delimited(rows.select("lemma", "l.target", lemmas.alias("tokens")), out)


def whitelist(spark, links, out, words=""):
    told = PipelineConfig.of(spark, **({"filter_words": words} if words else {})).whitelist
    kept = F.filter("links", lambda x: x["lemma"].isin(told) | F.concat(x["lemma"], F.lit(codec.LEMMA_END), x["target"]).isin(told))
    W.write_delimited(R.links(spark, links).select("sentence", kept.alias("links")).where(F.size("links") > 0), out)


def wordcount(spark, links, out):
    W.write_delimited(D.lemma_counts(D.noun_link_lemmas(R.tokenized(spark, links))), out, compression="gzip", order=[F.desc("cnt"), "word"])


def dictionary(spark, links, out):
    W.write_delimited(_sense(D.surface_form_counts(_mentions(R.links(spark, links)))), out, compression="gzip")


def senses(spark, counts, out, share="0"):
    W.write_delimited(D.sense_inventory(R.sense_counts(spark, counts), int(share) or None), out, compression="gzip", order=[F.desc("total"), "lemma"])


def sample(spark, links, out):
    c = PipelineConfig.of(spark)
    lines = R.links(spark, links).withColumn("encoded", codec.encode_links(F.col("links"))).withColumn("sid", F.xxhash64("sentence", "encoded"))
    mentions = lines.select("sid", F.explode("links").alias("l")).select("sid", F.col("l.lemma").alias("word"), "l.target").where("word is not null")
    by_sense = sampling.sample_senses(mentions, "sid", c.per_sense, c.max_senses, c.seed)
    by_word = sampling.sample_per_word(mentions, by_sense, "sid", c.per_word, c.per_sense, c.max_senses, c.seed)
    whole = lines.select("sid", "sentence", "encoded").distinct()
    named = by_sense.select(F.concat("word", F.lit(codec.LEMMA_END), "target").alias("word"), "sid").union(by_word.select("word", "sid"))
    W.write_delimited(named.join(whole, "sid").select("word", "sentence", "encoded"), out, compression="gzip")


def inlinks(spark, mentions, out, redirects=None):
    led = R.legacy_redirects(spark, redirects) if redirects else R.redirects(spark, None)
    W.write_delimited(S.histogram(S.inlink_counts(R.mentions(spark, mentions), led)), out, order=["cnt"])


def statistics(spark, mentions, pages, redirects, out):
    told, titles, led = R.mentions(spark, mentions), R.page_titles(spark, pages), R.bare_redirects(spark, redirects)
    texts = S.link_text_counts(told, led, titles)
    by_resource = S.surface_forms_per_resource(texts)
    counts, to = by_resource.select("resource", "cnt"), S.redirect_counts(led, titles)
    for name, df, order in (
        ("link-texts", texts, [F.desc("cnt"), "resource", "link_text"]),
        ("inlinks", counts, [F.desc("cnt"), "resource"]),
        ("surface-forms", by_resource, ["resource"]),
        ("inlink-histogram", S.histogram_with_zero(counts, titles, led), ["cnt"]),
        ("redirects", to, [F.desc("cnt"), "resource"]),
        ("redirect-histogram", S.histogram_with_zero(to, titles, led), ["cnt"]),
        ("counters", S.counters(told, led, titles), None),
    ):
        W.write_delimited(df, f"{out}/{name}", order=order)


def bytext(spark, links, out, words):
    rows = R.links(spark, links).withColumn("sid", F.xxhash64("sentence", codec.encode_links(F.col("links"))))
    W.write_delimited(filters.by_surface_text(rows, R.word_set(spark, words)).select("sentence", "links"), out)


def first(spark, links, out, most="100"):
    one = R.links(spark, links).where(F.size("links") > 0).select("sentence", F.get("links", F.lit(0)).alias("l")).where("l.lemma is not null")
    rows = one.select("l.lemma", "sentence", F.array("l").alias("links"), sampling.priority(PipelineConfig.of(spark).seed, "sentence").alias("p"))
    W.write_delimited(filters.first_per_key(rows, "lemma", ["p", "sentence"], int(most)).select("lemma", "sentence", "links"), out)


def midfrequency(spark, words, samples, out, least, top):
    kept = filters.mid_frequency(R.word_counts(spark, words), int(least), int(top))
    W.write_delimited(filters.samples_of(R.delimited(spark, samples, "word", "sentence", "links"), kept), f"{out}/samples", single_file=True)
    W.write_delimited(kept, f"{out}/words", single_file=True, order=[F.desc("cnt"), "word"])


def wordlist(spark, words, out, offset, limit):
    W.write_delimited(filters.word_list_slice(R.word_counts(spark, words), int(offset), int(limit)), out, single_file=True, order=[F.desc("cnt"), "word"])


def evaluate_clusters(spark, instances, out):
    rows = R.lines(spark, instances).select("fold", codec.columns_of(F.col("value")).alias("c")).where(F.size("c") == 3)
    told = rows.select("fold", F.col("c")[0].alias("word"), F.nullif(F.col("c")[1], F.lit("")).alias("cluster_id"), F.col("c")[2].alias("gold"))
    predicted = evaluate.predictions(told)
    W.write_delimited(predicted.select("word", "cluster_id", "sense", "gold"), f"{out}/instances")
    W.write_delimited(evaluate.metrics(predicted), f"{out}/metrics")
    W.write_delimited(evaluate.mapping(evaluate.confusion(told, ["word"]), ["word"]), f"{out}/baseline")
    W.write_delimited(evaluate.mapping(evaluate.confusion(told.where("cluster_id is not null"), ["word", "cluster_id"]), ["word", "cluster_id"]), f"{out}/mapping")


def lines(spark, path, out, n):
    W.write_delimited(sampling.random_lines(spark.read.text(path), int(n), "value", PipelineConfig.of(spark).seed), out, single_file=True)


COMMANDS = {f.__name__: f for f in (process, lemmatize, tokenize, whitelist, wordcount, dictionary, senses, sample, inlinks, statistics, bytext, first, midfrequency, wordlist, lines)} | {"evaluate": evaluate_clusters}


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    if not arguments or arguments[0] not in COMMANDS:
        print(__doc__)
        return 2
    COMMANDS[arguments[0]](spark or SparkSession.builder.appName(f"weftline {arguments[0]}").getOrCreate(), *arguments[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
