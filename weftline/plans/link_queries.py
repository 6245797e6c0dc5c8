"""Queries on mentions, senses, anchors, redirects and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import codec, names
from weftline.operators import dictionary as D
from weftline.operators import filters, redirects, sampling
from weftline.operators import statistics as S
from weftline.plans import bindings as B
from weftline.plans.registry import query

WHITELIST = ("red anvil", "blue rod", "hot ring@@Brand#7", "hot ring@@Brand#12", "new bolt@@Brand#3")


def _shown(senses):
    return senses.select("lemma", "total", "num_senses", codec.encode_counts(F.col("targets")).alias("targets"))


_INVENTORY = f"""WITH {B.COUNTS}, t AS (SELECT *, sum(cnt) OVER (PARTITION BY lemma) AS total FROM counts)
SELECT lemma, CAST(sum(cnt) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {{keep}}) AS BIGINT) AS num_senses,
coalesce(string_agg(target || ':' || cnt || '  ', '' ORDER BY cnt DESC, target) FILTER (WHERE {{keep}}), '') AS targets FROM t GROUP BY lemma"""


@query(f"WITH {B.COUNTS} SELECT * FROM counts")
def surface_form_dictionary(spark, sf):
    return D.surface_form_counts(B.mentions(spark, sf))


@query(_INVENTORY.format(keep="true"))
def sense_inventory_all(spark, sf):
    return _shown(D.sense_inventory(B.counts(spark, sf)))


@query(_INVENTORY.format(keep="cnt >= total // 10"))
def sense_inventory_min10pct(spark, sf):
    return _shown(D.sense_inventory(B.counts(spark, sf), min_share=10))


@query(f"WITH {B.MENTIONS} SELECT lemma AS word, CAST(count(*) AS BIGINT) AS cnt FROM mentions GROUP BY lemma ORDER BY cnt DESC, word")
def lemma_counts_sorted(spark, sf):
    return D.lemma_counts(B.mentions(spark, sf)).orderBy(F.desc("cnt"), "word")


@query(f"WITH {B.ANCHORS} SELECT * FROM anchors")
def anchor_extract(spark, sf):
    return B.anchors(spark, sf)


@query(f"WITH {B.RESOLVED} SELECT resource, CAST(count(*) AS BIGINT) AS cnt FROM resolved GROUP BY resource")
def anchor_inlinks(spark, sf):
    return S.inlink_counts(B.anchors(spark, sf), B.redirects(spark, sf))


def _fragments(spark, sf):
    """Anchors whose targets are given a fragment, an empty one, or none."""
    t = F.col("target")
    return B.anchors(spark, sf).select("page_id", "pos", F.when(F.length("link_text") % 3 == 0, F.concat(t, F.lit("#x"))).when(F.length("link_text") % 3 == 1, F.concat(t, F.lit("#"))).otherwise(t).alias("target"))


_FRAGMENTS = B.REDIRECTS + ", given AS (SELECT page_id, pos, target || CASE length(link_text) % 3 WHEN 0 THEN '#x' WHEN 1 THEN '#' ELSE '' END AS target FROM anchors), parted AS (SELECT *, split_part(target, '#', 1) AS bare, substr(target, length(split_part(target, '#', 1)) + 1) AS own FROM given)"


@query(f"WITH {_FRAGMENTS} SELECT page_id, pos, target, coalesce(CASE WHEN length(own) > 0 THEN split_part(destination, '#', 1) ELSE destination END, bare) || own AS resolved FROM parted LEFT JOIN redirects ON bare = source")
def redirect_resolve_keep(spark, sf):
    return redirects.resolve(_fragments(spark, sf), B.redirects(spark, sf), keep_fragment=True)


@query(f"WITH {_FRAGMENTS} SELECT page_id, pos, target, coalesce(split_part(destination, '#', 1), bare) AS resolved FROM parted LEFT JOIN redirects ON bare = source")
def redirect_resolve_drop(spark, sf):
    return redirects.resolve(_fragments(spark, sf), B.redirects(spark, sf))


@query(f"WITH {B.REDIRECTS} SELECT page_id, pos, coalesce(destination, target) AS resolved FROM anchors LEFT JOIN redirects ON target = source")
def redirect_resolve_verbatim(spark, sf):
    return redirects.resolve_verbatim(B.anchors(spark, sf), B.redirects(spark, sf)).select("page_id", "pos", "resolved")


@query("SELECT DISTINCT p_name AS name, upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') AS resource, replace(p_name, ' ', '_') AS legacy, split_part(p_brand, '#', 1) AS bare, CAST(length(p_name) AS INTEGER) AS units FROM part")
def format_resource_name(spark, sf):
    n = F.col("p_name")
    return B.table(spark, sf, "part").select(n.alias("name"), names.format_resource_name(n).alias("resource"), names.legacy_name(n).alias("legacy"), names.strip_fragment(F.col("p_brand")).alias("bare"), names.utf16_length(n).alias("units")).distinct()


@query(f"WITH {B.RESOLVED} SELECT cnt, CAST(count(*) AS BIGINT) AS n FROM (SELECT resource, CAST(count(*) AS BIGINT) AS cnt FROM resolved GROUP BY resource) GROUP BY cnt")
def inlink_histogram(spark, sf):
    return S.histogram(S.inlink_counts(B.anchors(spark, sf), B.redirects(spark, sf)))


_EXISTING = B.RESOLVED + ", found AS (SELECT * FROM resolved WHERE resource IN (SELECT resource FROM titles)), inlinks AS (SELECT resource, CAST(count(*) AS BIGINT) AS cnt FROM found GROUP BY resource)"


@query(f"WITH {_EXISTING} SELECT cnt, CAST(count(*) AS BIGINT) AS n FROM inlinks GROUP BY cnt UNION ALL SELECT 0, CAST((SELECT count(*) FROM titles) - (SELECT count(DISTINCT source) FROM redirects) - (SELECT count(*) FROM inlinks) AS BIGINT)")
def inlink_histogram_zero(spark, sf):
    r, t = B.redirects(spark, sf), B.titles(spark, sf)
    found = S.existing(redirects.resolve(B.anchors(spark, sf), r, into="resource"), t)
    return S.histogram_with_zero(found.groupBy("resource").agg(F.count("*").alias("cnt")), t, r)


@query(f"WITH {_EXISTING} SELECT resource, link_text, CAST(count(*) AS BIGINT) AS cnt FROM found GROUP BY ALL")
def link_text_counts(spark, sf):
    return S.link_text_counts(B.anchors(spark, sf), B.redirects(spark, sf), B.titles(spark, sf))


@query(f"WITH {_EXISTING} SELECT resource, CAST(count(*) AS BIGINT) AS cnt FROM found GROUP BY resource")
def surface_forms_per_resource(spark, sf):
    return S.surface_forms_per_resource(link_text_counts(spark, sf)).select("resource", "cnt")


@query(f"WITH {_EXISTING} SELECT resource, CAST(count(DISTINCT link_text) AS BIGINT) AS distinct_forms FROM found GROUP BY resource")
def surface_forms_per_resource_distinct(spark, sf):
    return S.surface_forms_per_resource(link_text_counts(spark, sf)).select("resource", "distinct_forms")


@query(f"WITH {B.TITLES} SELECT r AS resource, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT split_part(destination, '#', 1) AS r FROM redirects) WHERE r IN (SELECT resource FROM titles) GROUP BY r")
def redirect_in_counts(spark, sf):
    return S.redirect_counts(B.redirects(spark, sf), B.titles(spark, sf))


@query(f"WITH {_EXISTING} SELECT page_id, pos, resource FROM found")
def existing_page_links(spark, sf):
    return S.existing(redirects.resolve(B.anchors(spark, sf), B.redirects(spark, sf), into="resource"), B.titles(spark, sf)).select("page_id", "pos", "resource")


@query(f"""WITH {B.RESOLVED}, texts AS (SELECT link_text, count(DISTINCT resource) AS t FROM resolved GROUP BY link_text)
SELECT CAST((SELECT count(*) FROM resolved) AS BIGINT) AS num_links, CAST((SELECT count(*) FROM texts) AS BIGINT) AS num_link_texts, CAST((SELECT count(*) FROM texts WHERE t >= 2) AS BIGINT) AS num_polysemous_link_texts,
CAST((SELECT count(DISTINCT resource) FROM resolved) AS BIGINT) AS num_linked_resources, CAST((SELECT count(DISTINCT resource) FROM resolved WHERE resource IN (SELECT resource FROM titles)) AS BIGINT) AS num_linked_pages,
CAST((SELECT count(*) FROM titles) AS BIGINT) AS num_pages, CAST((SELECT count(DISTINCT source) FROM redirects) AS BIGINT) AS num_redirects""")
def global_link_counters(spark, sf):
    return S.counters(B.anchors(spark, sf), B.redirects(spark, sf), B.titles(spark, sf))


_WORDS = ", ".join(f"'{w}'" for w in WHITELIST)


@query(f"WITH {B.MENTIONS} SELECT * FROM mentions WHERE lemma IN ({_WORDS}) OR lemma || '@@' || target IN ({_WORDS})")
def whitelist_links(spark, sf):
    return filters.whitelisted(B.mentions(spark, sf), list(WHITELIST))


@query(f"WITH {B.MENTIONS}, words AS (SELECT DISTINCT p_name AS word FROM part WHERE p_size < 3 UNION SELECT p_name || '@@' || p_brand FROM part WHERE p_size > 47) SELECT * FROM mentions WHERE lemma IN (SELECT word FROM words) OR lemma || '@@' || target IN (SELECT word FROM words)")
def whitelist_links_by_table(spark, sf):
    part = B.table(spark, sf, "part")
    words = part.where("p_size < 3").select(F.col("p_name").alias("word")).union(part.where("p_size > 47").select(F.concat("p_name", F.lit(codec.LEMMA_END), "p_brand"))).distinct()
    return filters.whitelisted_by(B.mentions(spark, sf), words)


_LEMMAS = f"WITH {B.MENTIONS}, words AS (SELECT lemma AS word, CAST(count(*) AS BIGINT) AS cnt FROM mentions GROUP BY lemma)"
_MIDDLE = _LEMMAS + ", enough AS (SELECT * FROM words WHERE cnt >= (SELECT CAST(floor(avg(cnt)) AS BIGINT) FROM words) // 2), middle AS (SELECT * FROM enough WHERE word NOT IN (SELECT word FROM enough ORDER BY cnt DESC, word LIMIT 12))"


def _middle(spark, sf):
    words = D.lemma_counts(B.mentions(spark, sf))
    least = words.agg(F.expr("floor(avg(cnt)) div 2").alias("least"))  # one row
    return filters.mid_frequency(words.crossJoin(F.broadcast(least)).where("cnt >= least").select("word", "cnt"), 0, 12)


@query(_MIDDLE + " SELECT * FROM middle")
def mid_frequency_words(spark, sf):
    return _middle(spark, sf)


@query(_MIDDLE + " SELECT sid, lemma || '@@' || target AS word FROM mentions WHERE lemma IN (SELECT word FROM middle)")
def mid_frequency_samples(spark, sf):
    samples = B.mentions(spark, sf).select("sid", F.concat("lemma", F.lit(codec.LEMMA_END), "target").alias("word"))
    return filters.samples_of(samples, _middle(spark, sf))


_DOC_WORDS = r"WITH words AS (SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word)"


@query(_DOC_WORDS + r" SELECT word, cnt FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, word) AS r FROM words) WHERE r > 20 AND regexp_matches(word, '^\p{Ll}') ORDER BY cnt DESC, word LIMIT 200")
def word_list_offset_limit(spark, sf):
    words = B.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return filters.word_list_slice(words, 20, 200)


def _ordered(spark, sf):
    return B.mentions(spark, sf).distinct()


@query(f"WITH {B.MENTIONS} SELECT lemma, sid, target FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY sid, target) AS r FROM (SELECT DISTINCT * FROM mentions)) WHERE r <= 100")
def first_100_per_lemma(spark, sf):
    return filters.first_per_key(_ordered(spark, sf), "lemma", ["sid", "target"], 100).select("lemma", "sid", "target")


def _worded(spark, sf):
    return B.mentions(spark, sf).withColumnRenamed("lemma", "word")


_SAMPLE = f"""WITH {B.MENTIONS}, m AS (SELECT lemma AS word, target, sid FROM mentions),
poly AS (SELECT word FROM m GROUP BY word HAVING count(DISTINCT target) >= 2),
counts AS (SELECT word, target, CAST(count(*) AS BIGINT) AS cnt FROM m GROUP BY ALL),
top AS (SELECT word, target, cnt FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, target) AS r FROM counts) WHERE r <= 10),
drawn AS (SELECT word, target, sid FROM (SELECT *, row_number() OVER (PARTITION BY word, target ORDER BY md5('42|' || word || '|' || target || '|' || sid) DESC, sid) AS r FROM (SELECT DISTINCT word, target, sid FROM m)) WHERE r <= 3),
senses AS (SELECT d.* FROM drawn d JOIN top USING (word, target) WHERE word IN (SELECT word FROM poly)),
reservoir AS (SELECT word, sid, p FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY p DESC, sid) AS r FROM (SELECT word, sid, md5('43|' || word || '|' || sid) AS p FROM (SELECT DISTINCT word, sid FROM m) WHERE word IN (SELECT word FROM poly))) WHERE r <= 35),
rest AS (SELECT word, sid, row_number() OVER (PARTITION BY word ORDER BY p, sid) AS r FROM reservoir WHERE (word, sid) NOT IN (SELECT (word, sid) FROM senses))"""


@query(_SAMPLE + " SELECT * FROM senses")
def sample_per_sense(spark, sf):
    return sampling.sample_senses(_worded(spark, sf)).select("word", "target", "sid")


@query(_SAMPLE + " SELECT word, sid FROM rest WHERE r <= 5")
def sample_per_word(spark, sf):
    m = _worded(spark, sf)
    return sampling.sample_per_word(m, sampling.sample_senses(m))


@query(_SAMPLE + " SELECT * FROM top")
def top_senses(spark, sf):
    return sampling.top_senses(_worded(spark, sf))


@query(f"WITH {B.MENTIONS}, n AS (SELECT lemma, count(DISTINCT target) AS n FROM mentions GROUP BY lemma) SELECT CAST(count(*) AS BIGINT) AS num_link_texts, CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS num_polysemous_link_texts, CAST(count(*) FILTER (WHERE n > 10) AS BIGINT) AS num_polysemous_link_texts_cutoff FROM n")
def sampler_counters(spark, sf):
    return sampling.counters(_worded(spark, sf))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, md5('42|' || doc_id) AS p FROM documents) ORDER BY p, doc_id LIMIT 100")
def random_lines(spark, sf):
    return sampling.random_lines(B.table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id")


@query(f"WITH {B.MENTIONS}, links AS (SELECT sid, string_agg(lemma || '@@' || target || '@' || length(lemma) || ':' || length(target), '  ' ORDER BY lemma, target) AS encoded, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY sid) SELECT sid, encoded, encoded AS again, n FROM links")
def link_codec_round_trip(spark, sf):
    link = F.struct("lemma", "target", F.length("lemma").alias("begin"), F.length("target").alias("end"))
    made = B.mentions(spark, sf).groupBy("sid").agg(F.sort_array(F.collect_list(link)).alias("links"))
    encoded = made.select("sid", codec.encode_links(F.col("links")).alias("encoded")).withColumn("back", codec.decode_links(F.col("encoded")))
    return encoded.select("sid", "encoded", codec.encode_links(F.col("back")).alias("again"), F.size("back").cast("bigint").alias("n"))
