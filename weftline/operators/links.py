"""Links of a page: explicit ones by sentence, and implicit ones found by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import PipelineConfig
from weftline.functions import markup, names, text, wikitext
from weftline.functions.arrays import let


def page_sentences(pages: DataFrame, config: PipelineConfig | None = None, boundary: str = text.BOUNDARY) -> DataFrame:
    """(title, para, sent, text, links) of pages (title, text): cleaned, parsed, split; links lie in their sentence.

    A link belongs to a sentence if it begins in it and ends before its last character's end; a
    link that ends where the sentence ends is not taken. Pages and sentences over their maximal
    length go. sent counts the sentences of the page, also those that went.
    """
    config = config or PipelineConfig()
    cleaned = pages.where(F.length("text") <= config.max_page_length).select("title", markup.clean_markup(F.col("text")).alias("text"))
    # Paragraphs and sentences of a page stay in its row, which numbers them without a shuffle.
    sentence = lambda p, k, s: F.struct(k.alias("para"), p["links"].alias("plinks"), s.alias("s"))
    nested = F.transform(wikitext.paragraphs(F.col("text")), lambda p, k: F.transform(text.sentences(text.one_line(p["text"]), boundary), lambda s: sentence(p, k, s)))
    one = cleaned.select("title", F.posexplode(F.flatten(nested)).alias("sent", "x"))
    inside = F.filter("x.plinks", lambda l: (l["end"] > l["begin"]) & (l["begin"] >= F.col("x.s.begin")) & (l["end"] < F.col("x.s.end")))
    shifted = F.array_distinct(F.transform(inside, lambda l: F.struct(F.lit(None).cast("string").alias("lemma"), names.format_resource_name(l["target"]).alias("target"), (l["begin"] - F.col("x.s.begin")).alias("begin"), (l["end"] - F.col("x.s.begin")).alias("end"))))
    return one.select("title", F.col("x.para").alias("para"), "sent", F.col("x.s.text").alias("text"), shifted.alias("links")).where(F.length("text") <= config.max_sentence_length)


def explicit_links(sentences: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """Sentences with links, but for those with max_links or more."""
    config = config or PipelineConfig()
    return sentences.where((F.size("links") > 0) & (F.size("links") < config.max_links))


def implicit_links(sentences: DataFrame) -> DataFrame:
    """(title, sent, target, begin, end): link_occurrences that are no explicit links themselves."""
    return _exploded(_pages(sentences), F.array_except(_occurrences("ss"), _spans("ss")))


def link_occurrences(sentences: DataFrame) -> DataFrame:
    """(title, sent, target, begin, end): occurrences, anywhere in the page, of the texts of its links, the links among them.

    One sense per discourse: each text of a page's links points to the link's target wherever it
    stands as a word. A page is one row (its length is bounded), so its texts meet its sentences
    inside the row, after one exchange by title. Sentences without a title belong to no page.
    """
    return _exploded(_pages(sentences), F.array_distinct(_occurrences("ss")))


def link_spans(sentences: DataFrame) -> DataFrame:
    """(title, sent, target, begin, end) of the explicit links."""
    return sentences.select("title", "sent", F.explode("links").alias("l")).select("title", "sent", "l.target", "l.begin", "l.end")


def _pages(sentences: DataFrame) -> DataFrame:
    return sentences.where(F.col("title").isNotNull()).groupBy("title").agg(F.collect_list(F.struct("sent", "text", "links")).alias("ss"))


def _exploded(pages: DataFrame, found: Column) -> DataFrame:
    return pages.select("title", F.explode(found).alias("x")).select("title", "x.sent", "x.target", "x.begin", "x.end")


def _placed(s: Column, target: Column, begin: Column, end: Column) -> Column:
    return F.struct(s["sent"].alias("sent"), target.alias("target"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def _spans(sentences: str) -> Column:
    return F.flatten(F.transform(sentences, lambda s: F.transform(s["links"], lambda l: _placed(s, l["target"], l["begin"], l["end"]))))


def _occurrences(sentences: str) -> Column:
    """Where the texts of all links of the sentences stand in each of them."""
    word = lambda s, l: F.struct(F.substr(s["text"], l["begin"] + 1, l["end"] - l["begin"]).alias("word"), l["target"].alias("target"))
    words = F.filter(F.array_distinct(F.flatten(F.transform(sentences, lambda s: F.transform(s["links"], lambda l: word(s, l))))), lambda w: F.length(w["word"]) > 0)
    of = lambda s, w: F.transform(text.find_word(s["text"], w["word"]), lambda b: _placed(s, w["target"], b, b + F.length(w["word"])))
    met = lambda s, ws: F.flatten(F.transform(F.filter(ws, lambda w: F.contains(s["text"], w["word"])), lambda w: of(s, w)))
    return let(words, lambda ws: F.flatten(F.transform(sentences, lambda s: met(s, ws))))


def dedupe(links: DataFrame, *by: str) -> DataFrame:
    """The links (or mentions) that differ in the given columns, which alone are kept."""
    return links.select(*by).distinct()


def all_links(sentences: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """(title, sent, text, links, n_implicit): explicit and implicit links together; sentences with max_implicit_links or more go."""
    config = config or PipelineConfig()
    link = F.struct(F.lit(None).cast("string").alias("lemma"), "target", "begin", "end")
    more = implicit_links(sentences).groupBy("title", "sent").agg(F.sort_array(F.collect_list(link)).alias("more"))
    joined = sentences.join(more, ["title", "sent"], "left").withColumn("more", F.coalesce("more", F.expr("slice(links, 1, 0)")))
    return joined.select("title", "sent", "text", F.concat("links", "more").alias("links"), F.size("more").alias("n_implicit")).where((F.size("links") > 0) & (F.size("links") < config.max_implicit_links))
