"""Readers: page dumps, delimited text, word lists, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import codec, dependencies, names, text
from weftline.operators.redirects import one_each

_PAGE = "title string, ns string, redirect struct<_title:string>, revision struct<text:string>, _corrupt_record string"


def xml_pages(spark: SparkSession, path: str | list[str], row_tag: str = "page") -> DataFrame:
    """(title, ns, redirect, text) of the page elements of dumps, compressed or not.

    Only the article namespace (0 or none given) is kept. Elements that are no well-formed page have
    no title and are left out; `xml_rejects` returns them.
    """
    raw = _xml(spark, path, row_tag)
    ns = F.coalesce(F.trim("ns").try_cast("bigint"), F.lit(0))
    return raw.where(F.col("title").isNotNull() & F.col("_corrupt_record").isNull() & ((ns == 0) | F.col("ns").isNull())).select("title", ns.alias("ns"), F.col("redirect._title").alias("redirect"), F.col("revision.text").alias("text"))


def xml_rejects(spark: SparkSession, path: str | list[str], row_tag: str = "page") -> DataFrame:
    return _xml(spark, path, row_tag).where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def _xml(spark: SparkSession, path, row_tag: str) -> DataFrame:
    """Elements as their closing tags part them, so that a broken one spoils no other and large files split."""
    parts = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    element = F.regexp_extract("value", rf"(?s)(<{row_tag}(?:\s[^>]*)?>.*)$", 1)
    whole = parts.select(F.concat(element, F.lit(f"</{row_tag}>")).alias("xml")).where(F.length("xml") > len(row_tag) + 3)
    options = {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}
    return whole.select(F.from_xml("xml", _PAGE, options).alias("p")).select("p.*")


def xml_record(xml: Column) -> Column:
    """struct<title, redirect, text> of a page element held as text."""
    return F.struct(F.xpath_string(xml, F.lit("page/title")).alias("title"), F.xpath_string(xml, F.lit("page/redirect/@title")).alias("redirect"), F.xpath_string(xml, F.lit("page/revision/text")).alias("text"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, fold): lines of files, globs or folders, with the file each comes from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("fold"))


def delimited(spark: SparkSession, path: str | list[str], *columns: str) -> DataFrame:
    """Tab-separated rows that have exactly these columns; trailing empty columns do not count; other rows go."""
    split = spark.read.text(path).select(codec.columns_of(F.col("value")).alias("c")).where(F.size("c") == len(columns))
    return split.select(*(F.col("c")[k].alias(n) for k, n in enumerate(columns)))


def malformed(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """(value): the lines that `delimited` with so many columns leaves out."""
    return spark.read.text(path).where(F.size(codec.columns_of(F.col("value"))) != columns)


def redirects(spark: SparkSession, path: str | None) -> DataFrame:
    """(source, destination), one row a source; no path, no redirects."""
    if not path:
        return spark.createDataFrame([], "source string, destination string")
    return one_each(delimited(spark, path, "source", "destination"))


def legacy_redirects(spark: SparkSession, path: str) -> DataFrame:
    """Redirects whose names have blanks instead of underscores; letters stay as they are."""
    told = delimited(spark, path, "source", "destination")
    return one_each(told.select(names.legacy_name(F.col("source")).alias("source"), names.legacy_name(F.col("destination")).alias("destination")))


def bare_redirects(spark: SparkSession, path: str) -> DataFrame:
    """Redirects without the fragments of their destinations."""
    told = delimited(spark, path, "source", "destination")
    return one_each(told.select("source", names.strip_fragment(F.col("destination")).alias("destination")))


def page_titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("resource")).distinct()


def word_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, cnt); rows whose count is no number go."""
    return delimited(spark, path, "word", "n").select("word", codec.whole(F.col("n")).cast("bigint").alias("cnt")).where(F.col("cnt").isNotNull())


def links(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, links)"""
    return delimited(spark, path, "sentence", "encoded").select("sentence", codec.decode_links(F.col("encoded")).alias("links"))


def sense_counts(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, target, cnt) of `lemma@@target TAB count`."""
    rows = delimited(spark, path, "sense", "n").select(F.col("sense"), codec.whole(F.col("n")).cast("bigint").alias("cnt")).where(F.instr("sense", codec.LEMMA_END) > 0)
    return rows.select(F.substring_index("sense", codec.LEMMA_END, 1).alias("lemma"), F.substr("sense", F.instr("sense", codec.LEMMA_END) + 2).alias("target"), "cnt")


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """(link_text, target, sentence)"""
    return delimited(spark, path, "link_text", "target", "sentence")


def clusters(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """(word, cluster_id, feature, weight) of `word TAB cluster TAB feature:weight  feature:weight`, of the given words only."""
    rows = delimited(spark, path, "word", "cluster_id", "features")
    if words is not None:
        rows = rows.join(words.select("word").distinct(), "word", "left_semi")
    one = rows.select("word", "cluster_id", F.explode(F.split("features", codec.SEPARATOR)).alias("f"))
    form = r"^(.*):([0-9.eE+-]+)$"
    return one.select("word", "cluster_id", F.regexp_extract("f", form, 1).alias("feature"), F.regexp_extract("f", form, 2).try_cast("float").alias("weight")).where(F.col("weight").isNotNull())


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(word, gold, cnt) of `word TAB R:c  R:c`."""
    rows = delimited(spark, path, "word", "senses").select("word", F.explode(F.split("senses", codec.SEPARATOR)).alias("e"))
    return rows.select("word", codec.decode_count(F.col("e")).alias("c")).where(F.col("c").isNotNull()).select("word", F.col("c.target").alias("gold"), F.col("c.cnt").alias("cnt"))


def dependency_patterns(spark: SparkSession, path: str) -> list:
    """The patterns of a file, in its order; a pattern file is a few dozen lines that its author wrote."""
    text = spark.read.text(path, wholetext=True).first()
    return dependencies.parse_patterns(text["value"] if text else "")


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """(sid, sentence, links, tokens) of a links file, tokens by rule."""
    rows = links(spark, path).withColumn("sid", F.xxhash64("sentence", codec.encode_links(F.col("links"))))
    return rows.select("sid", "sentence", "links", text.tokens(F.col("sentence")).alias("tokens"))
