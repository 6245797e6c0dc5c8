"""The link relations, bound to the star-schema and page tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = r'<a href="/([^"]*)">([^<]*)</a>'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, lemma, target): a part's name stands for its brand; sid is the line's order."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sid"), F.col("p_name").alias("lemma"), F.col("p_brand").alias("target"))


MENTIONS = "mentions AS (SELECT l_orderkey AS sid, p_name AS lemma, p_brand AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lemma, target, cnt). Lines are counted by part before the join, so only one row a part meets it."""
    by_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("lemma"), F.col("p_brand").alias("target"))
    return by_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("lemma", "target").agg(F.sum("n").alias("cnt"))


COUNTS = MENTIONS + ", counts AS (SELECT lemma, target, CAST(count(*) AS BIGINT) AS cnt FROM mentions GROUP BY ALL)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, link_text, target) of the pages' internal anchors."""
    found = lambda g: F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(g))
    pages = table(spark, sf_dir, "pages").select("page_id", F.arrays_zip(found(1).alias("target"), found(2).alias("link_text")).alias("a"))
    return pages.select("page_id", F.posexplode("a").alias("pos", "x")).select("page_id", "pos", "x.link_text", "x.target")


ANCHORS = f"""anchor_lists AS (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS t, regexp_extract_all(html, '{ANCHOR}', 2) AS s FROM pages),
anchors AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS link_text, t[i] AS target FROM (SELECT page_id, t, s, unnest(range(1, len(t) + 1)) AS i FROM anchor_lists))"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, destination): targets whose length is a multiple of 3 lead to a page of their first letters, some to a fragment of it."""
    t = anchors(spark, sf_dir).select("target").distinct().where("length(target) % 3 = 0")
    return t.select(F.col("target").alias("source"), F.concat(F.lit("To_"), F.substring("target", 1, 2), F.when(F.length("target") % 2 == 0, "#part").otherwise("")).alias("destination"))


REDIRECTS = ANCHORS + """,
redirects AS (SELECT DISTINCT target AS source, 'To_' || substr(target, 1, 2) || CASE WHEN length(target) % 2 = 0 THEN '#part' ELSE '' END AS destination FROM anchors WHERE length(target) % 3 = 0)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource): targets with an even number of letters, redirects' sources, and half of their destinations."""
    r = redirects(spark, sf_dir)
    known = anchors(spark, sf_dir).where("length(target) % 2 = 0").select(F.col("target").alias("resource"))
    led = r.select(F.substring_index("destination", "#", 1).alias("resource")).where("length(resource) > 4")
    return known.union(led).union(r.select("source")).distinct()


TITLES = REDIRECTS + """,
titles AS (SELECT target AS resource FROM anchors WHERE length(target) % 2 = 0 UNION SELECT r FROM (SELECT split_part(destination, '#', 1) AS r FROM redirects) WHERE length(r) > 4 UNION SELECT source FROM redirects)"""
#: Where each anchor leads after at most one redirect, without fragments.
RESOLVED = TITLES + """,
resolved AS (SELECT page_id, pos, link_text, target, coalesce(split_part(destination, '#', 1), split_part(target, '#', 1)) AS resource FROM anchors LEFT JOIN redirects ON split_part(target, '#', 1) = source)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent, begin, end, text) of documents, split after every end mark."""
    from weftline.functions import text

    # Exploded as an expression: over a named array the optimiser would infer a filter, and split each text once more for it.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(text.one_line(F.col("text")), text.PLAIN_BOUNDARY)).alias("sent", "x"))
    return docs.select("doc_id", "sent", F.col("x.begin").alias("begin"), F.col("x.end").alias("end"), F.col("x.text").alias("text"))


SENTENCES = r"""marked AS (SELECT doc_id, string_split(regexp_replace(translate(text, chr(10), ' '), '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)) AS parts FROM documents),
pieces AS (SELECT doc_id, i, parts[i] AS piece, list_sum([length(x) FOR x IN parts[1:i - 1]]) AS before FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM marked)),
bodies AS (SELECT doc_id, i, coalesce(before, 0) + length(piece) - length(ltrim(piece)) AS b, trim(piece) AS text FROM pieces WHERE length(trim(piece)) > 0),
sentences AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sent, CAST(b AS INTEGER) AS "begin", CAST(b + length(text) AS INTEGER) AS "end", text FROM bodies)"""
