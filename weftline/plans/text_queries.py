"""Queries on markup, sentences, words, tokens and implicit links."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import codec, markup, text, wikitext
from weftline.functions.arrays import let, once, starts_of
from weftline.operators import dictionary as D
from weftline.operators import filters
from weftline.operators import links as L
from weftline.operators import statistics as S
from weftline.plans import bindings as B
from weftline.plans.registry import query

#: Markup around each page's title, so that every cleaning rule has something to do on every page.
_WRAPPED = "html || chr(10) || ' indented ' || url || chr(10) || '{{nowrap|' || page_id || '}} a<ref>b<ref name=\"x\">c</ref>d</ref><ref/> e<math>x{{y}}</math> {{t|{{u|{{v}}}}|w}}&nbsp;x&#8209;y<!-- z --->'"


def _pages(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.expr(_WRAPPED).alias("text"))


_PAGES = f"WITH RECURSIVE wrapped AS (SELECT page_id, {_WRAPPED} AS text FROM pages)"


def _fixpoint(name: str, source: str, pattern: str) -> str:
    """A recursive CTE that removes matches until none is left; `name` has the last state of each page."""
    return f"""{name}_steps AS (SELECT page_id, text, 0 AS k FROM {source} UNION ALL SELECT page_id, regexp_replace(text, '{pattern}', '', 'gs'), k + 1 FROM {name}_steps WHERE regexp_matches(text, '{pattern}', 's')),
{name} AS (SELECT page_id, arg_max(text, k) AS text FROM {name}_steps GROUP BY page_id)"""


@query(_PAGES + r" SELECT page_id, regexp_replace(text, '<!--.*?(-{2,3})>', '', 'gs') AS text FROM wrapped")
def strip_comments(spark, sf):
    return _pages(spark, sf).select("page_id", markup.strip_comments(F.col("text")).alias("text"))


@query(_PAGES + r" SELECT page_id, regexp_replace(replace(replace(text, '&nbsp;', ' '), '&#8209;', '-'), '\{\{nowrap\|([^{]*?)\}\}', '\1', 'gs') AS text FROM wrapped")
def plain_entities_nowrap(spark, sf):
    return _pages(spark, sf).select("page_id", markup.unwrap_nowrap(markup.plain_entities(F.col("text"))).alias("text"))


_REF = "<ref([^<]*?)>([^<]*?)</ref>"


@query(_PAGES + ", alone AS (SELECT page_id, regexp_replace(text, '<ref([^<]*?)/>', '', 'gs') AS text FROM wrapped), " + _fixpoint("done", "alone", _REF) + " SELECT page_id, text FROM done")
def strip_tags_fixpoint(spark, sf):
    return _pages(spark, sf).select("page_id", markup.strip_tag(F.col("text"), "ref").alias("text"))


_TEMPLATE = r"\{\{([^{]*?)\}\}"


@query(_PAGES + ", " + _fixpoint("done", "wrapped", _TEMPLATE) + " SELECT page_id, text FROM done")
def strip_templates_fixpoint(spark, sf):
    return _pages(spark, sf).select("page_id", markup.strip_templates(F.col("text")).alias("text"))


@query(_PAGES + r" SELECT page_id, regexp_replace(text, '\n .*', '', 'g') AS text FROM wrapped")
def strip_indented(spark, sf):
    return _pages(spark, sf).select("page_id", markup.strip_indented(F.col("text")).alias("text"))


def _clean_sql() -> str:
    parts = [_PAGES, r"""s0 AS (SELECT page_id, regexp_replace(replace(replace(regexp_replace(text, '<!--.*?(-{2,3})>', '', 'gs'), '&nbsp;', ' '), '&#8209;', '-'), '\{\{nowrap\|([^{]*?)\}\}', '\1', 'gs') AS text FROM wrapped)"""]
    at = "s0"
    for k, tag in enumerate(markup.TAGS, start=1):
        parts.append(f"a{k} AS (SELECT page_id, regexp_replace(text, '<{tag}([^<]*?)/>', '', 'gs') AS text FROM {at})")
        parts.append(_fixpoint(f"s{k}", f"a{k}", f"<{tag}([^<]*?)>([^<]*?)</{tag}>"))
        at = f"s{k}"
    parts.append(_fixpoint("t", at, _TEMPLATE))
    return ",\n".join(parts) + r" SELECT page_id, regexp_replace(text, '\n .*', '', 'g') AS text FROM t"


@query(_clean_sql())
def clean_markup(spark, sf):
    return _pages(spark, sf).select("page_id", markup.clean_markup(F.col("text")).alias("text"))


@query(f"WITH {B.SENTENCES} SELECT doc_id, sent, text FROM sentences")
def sentence_split(spark, sf):
    return B.sentences(spark, sf).select("doc_id", "sent", "text")


@query(f"WITH {B.SENTENCES} SELECT doc_id, sent, \"begin\", \"end\" FROM sentences")
def sentence_offsets(spark, sf):
    return B.sentences(spark, sf).select("doc_id", "sent", "begin", "end")


@query(f"WITH {B.SENTENCES} SELECT doc_id, sent, CAST(length(text) AS INTEGER) AS n FROM sentences WHERE length(text) <= 80 AND doc_id IN (SELECT doc_id FROM documents WHERE length(text) <= 5000)")
def long_sentence_filter(spark, sf):
    pages = filters.within_lengths(B.table(spark, sf, "documents"), 5000).select("doc_id")
    kept = filters.within_lengths(B.sentences(spark, sf), 80)
    return kept.join(pages, "doc_id", "left_semi").select("doc_id", "sent", F.length("text").alias("n"))


@query(r"""WITH RECURSIVE words AS (SELECT doc_id, text, 0 AS off, 0 AS found FROM documents
UNION ALL SELECT doc_id, substr(text, p + 3), off + p + 2, off + p FROM (SELECT doc_id, text, off, strpos(text, 'the') AS p FROM words) WHERE p > 0)
SELECT doc_id, CAST(found - 1 AS INTEGER) AS "begin" FROM words JOIN documents d USING (doc_id) WHERE found > 0
AND NOT regexp_matches(substr(d.text, greatest(found - 1, 1), CASE WHEN found > 1 THEN 1 ELSE 0 END), '\p{L}') AND NOT regexp_matches(substr(d.text, found + 3, 1), '\p{L}')""")
def find_word_occurrences(spark, sf):
    found = B.table(spark, sf, "documents").select("doc_id", F.explode(text.find_word(F.col("text"), "the")).alias("begin"))
    return found


def _discourse(spark, sf):
    """Sentences of documents with one explicit link each to the first long word of the sentence, where it stands alone."""
    first = F.regexp_extract("text", r"^[^ ]{5,} ", 0)
    rows = B.sentences(spark, sf).withColumn("w", F.substr(first, F.lit(1), F.length(first) - 1)).where(F.col("w").rlike(r"^\p{L}+$") | (F.col("w") == ""))
    link = F.struct(F.lit(None).cast("string").alias("lemma"), F.concat(F.lit("To_"), "w").alias("target"), F.lit(0).alias("begin"), F.length("w").alias("end"))
    none = F.expr("cast(array() as array<struct<lemma:string,target:string,begin:int,end:int>>)")
    return rows.select(F.col("doc_id").cast("string").alias("title"), "sent", "text", F.when(F.col("w") == "", none).otherwise(F.array(link)).alias("links"))


_IMPLICIT = rf"""WITH {B.SENTENCES}, discourse AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS title, sent, text, CASE WHEN regexp_matches(text, '^[^ ]{{5,}} ') THEN regexp_extract(text, '^([^ ]{{5,}}) ', 1) ELSE '' END AS w FROM sentences) WHERE w = '' OR regexp_matches(w, '^\p{{L}}+$')),
words AS (SELECT DISTINCT title, w AS word, 'To_' || w AS target FROM discourse WHERE w <> ''),
parted AS (SELECT d.title, d.sent, d.text, word, target, string_split(d.text, word) AS p FROM discourse d JOIN words w ON d.title = w.title AND contains(d.text, word)),
met AS (SELECT *, CAST(list_sum([length(x) + length(word) FOR x IN p[1:i]]) AS BIGINT) - length(word) AS b FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parted)),
occurrences AS (SELECT DISTINCT title, sent, target, CAST(b AS INTEGER) AS "begin", CAST(b + length(word) AS INTEGER) AS "end" FROM met WHERE NOT regexp_matches(substr(text, greatest(b, 1), CASE WHEN b > 0 THEN 1 ELSE 0 END), '\p{{L}}') AND NOT regexp_matches(substr(text, b + length(word) + 1, 1), '\p{{L}}')),
spans AS (SELECT title, sent, 'To_' || w AS target, 0 AS "begin", CAST(length(w) AS INTEGER) AS "end" FROM discourse WHERE w <> ''),
implicit AS (SELECT * FROM occurrences EXCEPT SELECT * FROM spans)"""


@query(_IMPLICIT + " SELECT * FROM implicit")
def implicit_links(spark, sf):
    return L.implicit_links(_discourse(spark, sf))


@query(_IMPLICIT + """, more AS (SELECT title, sent, string_agg(target || '@' || "begin" || ':' || "end", '  ' ORDER BY target, "begin", "end") AS more, count(*) AS n FROM implicit GROUP BY ALL),
own AS (SELECT title, sent, CASE WHEN w <> '' THEN 'To_' || w || '@0:' || length(w) END AS own FROM discourse)
SELECT title, sent, concat_ws('  ', own, more) AS links, CAST(coalesce(n, 0) AS INTEGER) AS n_implicit FROM own LEFT JOIN more USING (title, sent) WHERE coalesce(n, 0) + CASE WHEN own IS NULL THEN 0 ELSE 1 END BETWEEN 1 AND 9999""")
def explicit_union_implicit(spark, sf):
    out = L.all_links(_discourse(spark, sf))
    return out.select("title", "sent", codec.encode_links(F.col("links")).alias("links"), "n_implicit")


@query(_IMPLICIT + " SELECT * FROM implicit")
def implicit_minus_explicit_links(spark, sf):
    """The set difference of all sentences' link occurrences and explicit links, taken inside each page, which is read once."""
    return L.implicit_links(_discourse(spark, sf))


@query(f"WITH {B.ANCHORS} SELECT DISTINCT page_id, link_text, target FROM anchors")
def dedupe_links(spark, sf):
    return L.dedupe(B.anchors(spark, sf), "page_id", "link_text", "target")


def _all_tokens(spark, sf):
    """All sentences with blank-separated tokens; words that end in `ed` count as verbs, others as nouns."""

    def of(words):
        def item(w, b):
            return F.struct(b.alias("begin"), (b + F.length(w)).alias("end"), w.alias("text"), F.when(F.endswith(w, F.lit("ed")), "VB").otherwise("NN").alias("pos"), F.lower(w).alias("lemma"))

        return let(starts_of(F.transform(words, lambda w: F.length(w) + 1)), lambda at: F.transform(words, lambda w, k: item(w, F.get(at, k))))

    return B.sentences(spark, sf).select(F.concat_ws(":", "doc_id", "sent").alias("sid"), "doc_id", "sent", F.col("text").alias("sentence"), once(let(F.split("text", " "), of)).alias("tokens"))


def _spans(tokens):
    """Links over the second token, over the second and third, and over half of the second."""
    t = lambda k: F.get("tokens", F.lit(k - 1))
    link = lambda b, e, name: F.struct(F.lit(None).cast("string").alias("lemma"), F.lit(name).alias("target"), b.alias("begin"), e.alias("end"))
    rows = tokens.where(F.size(F.split("sentence", " ")) > 2)  # of the plain column, so that tokens are not made twice
    return rows.withColumn("links", F.array(link(t(2)["begin"], t(2)["end"], "One"), link(t(2)["begin"], t(3)["end"], "Two"), link(t(2)["begin"], (t(2)["begin"] + t(2)["end"]).cast("int") - t(2)["begin"] - 1, "Half")))


def _covered(spark, tokens):
    led = spark.createDataFrame([("One", "1"), ("Half", "1/2")], "source string, destination string")
    rows = _spans(tokens).where(F.length(F.get(F.split("sentence", " "), F.lit(1))) > 0)
    made = D.lemmatize_links(rows, F.broadcast(led))  # two rows
    return made.select("sid", codec.encode_links(F.col("links")).alias("links"))


@query(f"""WITH {B.SENTENCES}, ws AS (SELECT string_split(text, ' ') AS ws FROM sentences), one AS (SELECT ws, NOT ends_with(ws[2], 'ed') AS noun FROM ws WHERE len(ws) > 2)
SELECT CAST(3 * count(*) AS BIGINT) AS num_links, CAST(sum(2 * len(ws) + CASE WHEN noun THEN 2 ELSE len(ws) END) AS BIGINT) AS num_tokens, CAST(count(*) FILTER (WHERE noun) AS BIGINT) AS num_noun_links FROM one""")
def word_count_counters(spark, sf):
    """Links, tokens looked at, and links that are exactly a noun."""
    return S.noun_link_counters(_spans(_all_tokens(spark, sf)))


_SECOND = f"""WITH {B.SENTENCES}, second AS (SELECT doc_id, sent, ws[2] AS w, CAST(length(ws[1]) + 1 AS INTEGER) AS b FROM (SELECT doc_id, sent, string_split(text, ' ') AS ws FROM sentences) WHERE len(ws) > 2 AND NOT ends_with(ws[2], 'ed'))"""


@query(_SECOND + " SELECT doc_id || ':' || sent AS sid, lower(w) AS lemma, 'One' AS target, b AS \"begin\", CAST(b + length(w) AS INTEGER) AS \"end\" FROM second")
def token_span_join_whole(spark, sf):
    """Links whose span is exactly one noun, with its lemma."""
    sentences = _spans(_all_tokens(spark, sf)).select(F.col("sid").alias("sentence"), "tokens", "links")
    return D.noun_link_lemmas(sentences).withColumnRenamed("sentence", "sid")


@query(_SECOND + " SELECT doc_id || ':' || sent AS sid, lower(w) || '@@1@' || b || ':' || (b + length(w)) AS links FROM second WHERE length(w) > 0")
def covered_tokens_whole(spark, sf):
    """Links that cover exactly one token, a noun; their targets go through a redirect."""
    return _covered(spark, _all_tokens(spark, sf))


@query(f"""WITH {B.SENTENCES}, words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark),
two AS (SELECT doc_id || ':' || sent AS sid, text AS sentence, string_split(text, ' ') AS ws FROM sentences),
found AS (SELECT sid, sentence, concat_ws('  ', CASE WHEN ws[1] IN (SELECT word FROM words) THEN 'First@0:' || length(ws[1]) END, CASE WHEN ws[2] IN (SELECT word FROM words) THEN 'Second@' || (length(ws[1]) + 1) || ':' || (length(ws[1]) + 1 + length(ws[2])) END) AS links FROM two WHERE len(ws) > 1)
SELECT * FROM found WHERE links <> ''""")
def surface_text_filter(spark, sf):
    """Links over the first two words of all sentences, kept where their text is a word of the benchmark."""
    words = B.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    ws = F.split("text", " ")
    rows = B.sentences(spark, sf).select(F.concat_ws(":", "doc_id", "sent").alias("sid"), F.col("text").alias("sentence"), F.length(F.get(ws, F.lit(0))).alias("a"), F.length(F.get(ws, F.lit(1))).alias("b")).where(F.col("b").isNotNull())
    link = lambda b, e, name: F.struct(F.lit(None).cast("string").alias("lemma"), F.lit(name).alias("target"), b.alias("begin"), e.alias("end"))
    links = F.array(link(F.lit(0), F.col("a"), "First"), link(F.col("a") + 1, F.col("a") + 1 + F.col("b"), "Second"))
    return filters.by_surface_text(rows.select("sid", "sentence", links.alias("links")), words).select("sid", "sentence", codec.encode_links(F.col("links")).alias("links"))


def _lined(spark, sf):
    """Documents as lines `sentence TAB links`, each line linked as a whole to its place; tabs of the text become blanks."""
    line = lambda x, k: F.when(F.length(x) > 0, F.concat(x, F.lit("\t"), k.cast("string"), F.lit("@0:"), F.length(x).cast("string"))).otherwise("")
    lines = F.transform(F.split(F.translate("text", "\t", " "), "\n"), line)
    return B.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("document"))


@query("WITH lined AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), rebased AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM lined WHERE length(line) > 0) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(shift AS BIGINT) AS \"begin\", CAST(shift + length(line) AS BIGINT) AS \"end\" FROM rebased")
def document_text_rebase(spark, sf):
    """Spans of a document's non-empty lines in the text of these lines, each with its line break."""
    found = _lined(spark, sf).select("doc_id", F.explode(codec.document_links(F.col("document"))).alias("x"))
    return found.select("doc_id", F.col("x.resource").cast("int").alias("pos"), F.col("x.begin").cast("bigint").alias("begin"), F.col("x.end").cast("bigint").alias("end"))


@query("SELECT doc_id, list_aggregate(list_transform(list_filter(string_split(translate(text, chr(9), ' '), chr(10)), lambda x: length(x) > 0), lambda x: x || chr(10)), 'string_agg', '') AS text FROM documents WHERE length(replace(text, chr(10), '')) > 0")
def document_text_lines(spark, sf):
    """The text that document_text_rebase's spans lie in."""
    return _lined(spark, sf).select("doc_id", codec.document_text(F.col("document")).alias("text")).where("text <> ''")


@query(_PAGES.replace("WITH RECURSIVE", "WITH") + " SELECT page_id, 'Page_' || page_id AS title, CASE WHEN page_id % 5 = 0 THEN 'Page ' || (page_id + 1) END AS redirect, CAST(length(url) AS INTEGER) AS n FROM pages WHERE page_id % 3 <> 0")
def xml_pages(spark, sf):
    """Titles, redirects and text lengths of page elements held as text; pages of other namespaces are left out."""
    from weftline.sources.readers import xml_record

    esc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    element = F.concat(F.lit("<page><title>Page "), F.col("page_id").cast("string"), F.lit("</title><ns>"), F.when(F.col("page_id") % 3 == 0, "1").otherwise("0"), F.lit("</ns>"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<redirect title="Page '), (F.col("page_id") + 1).cast("string"), F.lit('"/>'))).otherwise(""), F.lit("<revision><text>"), esc, F.lit("</text></revision></page>"))
    from weftline.functions.names import format_resource_name

    r = B.table(spark, sf, "pages").select("page_id", element.alias("xml")).where(F.xpath_string("xml", F.lit("page/ns")) == "0").select("page_id", xml_record(F.col("xml")).alias("r"))
    return r.select("page_id", format_resource_name(F.col("r.title")).alias("title"), F.nullif(F.col("r.redirect"), F.lit("")).alias("redirect"), F.length("r.text").alias("n"))


@query()
def wikitext_links(spark, sf):
    """Sentences and links of pages written in markup: the documents' first sentences with their second words linked."""
    body = F.regexp_replace(F.col("text"), r"(?m)^(\S+) (\p{L}+) ", "== Part ==\n$1 [[target of $2|$2]] {{x|{{y}}}}''")
    pages = B.table(spark, sf, "documents").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), body.alias("text"))
    return L.page_sentences(pages).select("title", "sent", "text", codec.encode_links(F.col("links")).alias("links"))


@query()
def wikitext_paragraphs(spark, sf):
    rows = B.table(spark, sf, "pages").select("page_id", F.posexplode(wikitext.paragraphs(markup.clean_markup(F.col("html")))).alias("para", "p"))
    return rows.select("page_id", "para", F.length("p.text").alias("n"))


@query()
def noun_counts(spark, sf):
    """Lemmas of the nouns of all sentences, tagged and lemmatised by rule."""
    return text.lemma_counts(B.sentences(spark, sf), ("NN", "NNS"))
