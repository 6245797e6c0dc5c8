"""A corpus pipeline of five stages over `documents`; each is one operator at work on what the stage before it kept.

Stages read and return the columns of documents (the last adds the tokens' columns). They behave
alike for every table that has doc_id and text, whatever its other columns; n_chars is brought up
to date where a stage changes a text. Null texts are empty texts to every operator; each operator's
docstring says what becomes of odd rows. In short: documents without words stay what they are, an
empty table passes through empty, rows that share a doc_id are one document to the n-gram Jaccard join
(one row of them stays), other columns are carried along whatever their names, and texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, jaccard_join, quality, substring_dedup
from weftline.llm.queries import digests, held_out, tokenizer_path
from weftline.llm.shared import materialize, quoted, table


def _columns(made: DataFrame, docs: DataFrame) -> DataFrame:
    return made.select(*(quoted(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject (score 0.3 or more); labels of the folds not held out teach it."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    narrow = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("__row"), "text")
    kept = quality.score(narrow, model).where("predicted = 1")
    return kept.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id (of rows that share it, one)."""
    groups = jaccard_join.jaccard_join(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id or (doc_id is not null and component_id is null)").select("doc_id").distinct()
    once = docs.join(gone, "doc_id", "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    # Rows that share a doc_id are rare and are one document: of them one row stays, the first by text.
    repeated = once.join(again, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(quoted(c)) for c in docs.columns)), F.struct(F.length("text"), "text")).alias("r"))
    single = once.join(again, "doc_id", "left_anti")
    return _columns(single, docs).unionByName(repeated.select(*(F.col("r")[c].alias(c) for c in docs.columns)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text the words of every window of 20 words that also starts earlier; texts without one stay as they are."""
    names = docs.columns
    narrow = docs.select("doc_id", "text", F.struct(*(F.col(quoted(c)) for c in names if c not in ("doc_id", "text"))).alias("row")) if len(names) > 2 else docs.select("doc_id", "text", F.lit(None).alias("row"))
    made = substring_dedup.substring_dedup(narrow)
    cut = F.col("n_removed") > 0

    def column(c: str):
        if c == "text":
            return F.when(cut, F.col("kept")).otherwise(F.col("text")).alias(c)
        if c == "n_chars":
            return F.when(cut, F.length("kept")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c)
        return F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c)

    return made.select(*(column(c) for c in names))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    narrow = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("__row"), "text")
    found = decontaminate.decontaminate(narrow, table(spark, sf_dir, "benchmark").select("item_id", "text")).where("n_hit = 0")
    return found.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds to each document the number of its tokens, and digests of its ids and of the text decoded from them."""
    added = (("ids_sha256", "string"), ("decoded_sha256", "string"))
    return bpe.encode(docs, tokenizer_path(), digest=digests, digest_fields=added).select(*(quoted(c) for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
#: SQL cannot express the classifier and the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
