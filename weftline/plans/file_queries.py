"""Queries through files: relations are written by the writers and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import codec
from weftline.operators import dictionary as D
from weftline.plans import bindings as B
from weftline.plans.registry import query
from weftline.plans.scratch import folder
from weftline.sources import readers as R
from weftline.sources import writers as W


def _written(spark, df, tag, **how):
    return W.write_delimited(df, folder(spark, tag), **how)


def _text(spark, column, rows, tag):
    path = folder(spark, tag)
    rows.select(column.alias("value")).write.text(path)
    return path


@query(f"WITH {B.REDIRECTS} SELECT source, destination FROM redirects")
def redirects_file(spark, sf):
    return R.redirects(spark, _written(spark, B.redirects(spark, sf), "redirects"))


@query(f"WITH {B.REDIRECTS} SELECT replace(source, ' ', '_') AS source, replace(destination, ' ', '_') AS destination FROM redirects")
def legacy_redirects_file(spark, sf):
    return R.legacy_redirects(spark, _written(spark, B.redirects(spark, sf), "legacy"))


@query(f"WITH {B.REDIRECTS} SELECT source, split_part(destination, '#', 1) AS destination FROM redirects")
def bare_redirects_file(spark, sf):
    return R.bare_redirects(spark, _written(spark, B.redirects(spark, sf), "bare", compression="gzip"))


@query(f"WITH {B.TITLES} SELECT DISTINCT resource FROM titles")
def page_titles_file(spark, sf):
    twice = B.titles(spark, sf).union(B.titles(spark, sf))
    return R.page_titles(spark, _written(spark, twice, "titles"))


@query("SELECT DISTINCT p_name AS word FROM part")
def word_set_file(spark, sf):
    return R.word_set(spark, _written(spark, B.table(spark, sf, "part").select("p_name"), "words"))


@query(f"WITH {B.MENTIONS} SELECT lemma AS word, CAST(count(*) AS BIGINT) AS cnt FROM mentions GROUP BY lemma")
def word_counts_file(spark, sf):
    """Counts by word; a line whose count is no number goes."""
    counts = D.lemma_counts(B.mentions(spark, sf)).select("word", F.col("cnt").cast("string").alias("cnt"))
    broken = counts.select(F.concat(F.lit("broken "), "word"), F.lit("many"))
    return R.word_counts(spark, _written(spark, counts.union(broken), "counts"))


@query(f"WITH {B.MENTIONS} SELECT CAST(sid AS VARCHAR) AS sentence, string_agg(lemma || '@@' || target || '@' || length(lemma) || ':' || length(target), '  ' ORDER BY lemma, target) AS links FROM mentions GROUP BY sid")
def links_file(spark, sf):
    link = F.struct("lemma", "target", F.length("lemma").alias("begin"), F.length("target").alias("end"))
    made = B.mentions(spark, sf).groupBy("sid").agg(F.sort_array(F.collect_list(link)).alias("links"))
    return R.links(spark, _written(spark, made, "links")).select("sentence", codec.encode_links(F.col("links")).alias("links"))


@query(f"WITH {B.COUNTS} SELECT lemma, target, cnt FROM counts")
def sense_counts_file(spark, sf):
    counts = D.surface_form_counts(B.mentions(spark, sf)).select(F.concat("lemma", F.lit(codec.LEMMA_END), "target").alias("sense"), "cnt")
    return R.sense_counts(spark, _written(spark, counts, "senses", compression="gzip"))


@query(f"WITH {B.COUNTS} SELECT lemma AS word, target AS gold, cnt FROM counts")
def baseline_file(spark, sf):
    """Counts of targets as `target:count` elements of one line a lemma, and back."""
    senses = D.sense_inventory(D.surface_form_counts(B.mentions(spark, sf)))
    line = F.concat("lemma", F.lit("\t"), F.array_join(F.transform("targets", lambda x: F.concat(x["target"], F.lit(":"), x["cnt"].cast("string"))), codec.SEPARATOR))
    return R.baseline(spark, _text(spark, line, senses, "baseline"))


@query(f"WITH {B.COUNTS} SELECT lemma AS word, 'c' || length(lemma) AS cluster_id, target AS feature, CAST(cnt AS FLOAT) AS weight FROM counts WHERE lemma IN (SELECT p_name FROM part WHERE p_size < 25)")
def clusters_file(spark, sf):
    """Clusters with weighted features, of the words asked for."""
    senses = D.sense_inventory(D.surface_form_counts(B.mentions(spark, sf)))
    line = F.concat("lemma", F.lit("\tc"), F.length("lemma").cast("string"), F.lit("\t"), F.array_join(F.transform("targets", lambda x: F.concat(x["target"], F.lit(":"), x["cnt"].cast("string"))), codec.SEPARATOR))
    words = B.table(spark, sf, "part").where("p_size < 25").select(F.col("p_name").alias("word"))
    return R.clusters(spark, _text(spark, line, senses, "clusters"), words)


@query(f"WITH {B.ANCHORS} SELECT link_text, target, CAST(page_id AS VARCHAR) AS sentence FROM anchors WHERE NOT contains(link_text || target, chr(10)) AND NOT contains(link_text || target, chr(9)) AND NOT contains(link_text || target, chr(13))")
def mentions_file(spark, sf):
    plain = B.anchors(spark, sf).where(~F.concat("link_text", "target").rlike(r"[\n\r\t]"))
    return R.mentions(spark, _written(spark, plain.select("link_text", "target", "page_id"), "mentions"))


_PART_LINE = "CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(9) || p_brand || chr(9) || chr(9) ELSE p_name || chr(9) || p_brand || chr(9) || p_size END"


@query("SELECT p_name AS name, p_brand AS brand FROM part WHERE p_size % 3 = 1")
def delimited_rows(spark, sf):
    """Of lines with one, two and three columns those with two; trailing empty columns do not count."""
    return R.delimited(spark, _text(spark, F.expr(_PART_LINE), B.table(spark, sf, "part"), "rows"), "name", "brand")


@query(f"SELECT {_PART_LINE} AS value FROM part WHERE p_size % 3 <> 1")
def malformed_rows(spark, sf):
    """The lines that delimited_rows leaves out."""
    return R.malformed(spark, _text(spark, F.expr(_PART_LINE), B.table(spark, sf, "part"), "rows"), 2)


@query("SELECT lang AS value, lang || '.txt' AS fold FROM documents")
def lines_of_files(spark, sf):
    """Lines of several files by a pattern of their names, with the file that each comes from."""
    path, docs = folder(spark, "lines"), B.table(spark, sf, "documents").select("lang")
    for k, name in enumerate(sorted(r["lang"] for r in docs.distinct().collect())):  # a handful of languages
        part = f"{path}/{k}"
        docs.where(F.col("lang") == name).coalesce(1).write.text(part)
        _renamed(spark, part, f"{path}/{name}.txt")
    return R.lines(spark, f"{path}/*.txt")


def _renamed(spark, part: str, to: str) -> None:
    """Moves the only data file of a folder."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = kind(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.rename(system.globStatus(kind(f"{part}/part-*"))[0].getPath(), kind(to))


_ELEMENT = """'<page>' || chr(10) || ' <title>Page ' || page_id || '</title><ns>' || CASE WHEN page_id % 3 = 0 THEN '1' ELSE '0' END || '</ns>' || CASE WHEN page_id % 5 = 0 THEN '<redirect title="Page ' || (page_id + 1) || '"/>' ELSE '' END || chr(10) || '<revision><text>' || replace(replace(url, '&', '&amp;'), '<', '&lt;') || '</text></revision>' || CASE WHEN page_id % 7 = 0 THEN '<broken>' ELSE '' END || '</page>'"""
_DUMP = """SELECT 'Page ' || page_id AS title, CASE WHEN page_id % 5 = 0 THEN 'Page ' || (page_id + 1) END AS redirect, url AS text, page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 7 <> 0"""


@query(f"SELECT title, redirect, CAST(length(text) AS INTEGER) AS n FROM ({_DUMP})")
def xml_dump_pages(spark, sf):
    """Page elements of a dump; those of other namespaces and broken ones are left out."""
    pages = R.xml_pages(spark, _text(spark, F.expr(_ELEMENT), B.table(spark, sf, "pages"), "dump"))
    return pages.select("title", "redirect", F.length("text").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS rejects FROM pages WHERE page_id % 7 = 0")
def xml_dump_rejects(spark, sf):
    return R.xml_rejects(spark, _text(spark, F.expr(_ELEMENT), B.table(spark, sf, "pages"), "dump")).agg(F.count("*").alias("rejects"))


@query(f"SELECT 'pages' AS relation, replace(title, ' ', '_') AS value FROM ({_DUMP}) UNION ALL SELECT 'redirects', replace(title, ' ', '_') || chr(9) || replace(redirect, ' ', '_') FROM ({_DUMP}) WHERE redirect IS NOT NULL")
def dump_relations(spark, sf):
    """Pages and redirects as a dump's parse writes them, each relation to its own file."""
    paths = W.write_dump(R.xml_pages(spark, _text(spark, F.expr(_ELEMENT), B.table(spark, sf, "pages"), "dump")), folder(spark, "relations"))
    told = [spark.read.text(paths[n]).select(F.lit(n).alias("relation"), "value") for n in ("pages", "redirects")]
    return told[0].union(told[1])


@query(f"WITH {B.MENTIONS}, w AS (SELECT lemma AS word, count(*) AS cnt FROM mentions GROUP BY lemma) SELECT word || chr(9) || cnt AS value, CAST(row_number() OVER (ORDER BY cnt DESC, word) - 1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS files FROM w")
def sorted_single_file(spark, sf):
    """Counts written in order to one compressed file, with the place of each line in it."""
    path = _written(spark, D.lemma_counts(B.mentions(spark, sf)), "sorted", compression="gzip", single_file=True, order=[F.desc("cnt"), "word"])
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"), F.col("_metadata.file_name").alias("f"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count_distinct("f").alias("files")))).select("value", "pos", "files")  # one row


@query("SELECT unnest(['free', 'free1', 'free2']) AS name, unnest([0, 1, 2]) AS n")
def next_free_paths(spark, sf):
    """Three outputs to one path: none overwrites another."""
    base = f"{folder(spark, 'paths')}/free"
    made = [W.write_delimited(spark.range(k).select("id"), base) for k in range(3)]
    each = [spark.read.text(p).agg(F.lit(p.rsplit("/", 1)[1]).alias("name"), F.count("*").cast("int").alias("n")) for p in made]
    return each[0].union(each[1]).union(each[2])


@query("SELECT lower(p_name) AS word FROM part WHERE p_size < 10 INTERSECT SELECT lower(p_name) FROM part")
def whitelist_setting(spark, sf):
    """Words of a comma-separated setting, blanks around them left out, against lemmas."""
    from weftline.config import PipelineConfig
    from weftline.operators import filters

    told = PipelineConfig(filter_words=" , ".join(sorted(r["p_name"] for r in B.table(spark, sf, "part").where("p_size < 10").select("p_name").distinct().collect())))  # a setting's words
    lemmas = B.table(spark, sf, "part").select(F.col("p_name").alias("lemma"), F.col("p_brand").alias("target"))
    return filters.whitelisted(lemmas, told.whitelist).select(F.lower("lemma").alias("word")).distinct()
