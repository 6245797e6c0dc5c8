"""The queries op1 to op10: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, embedding_dedup, jaccard_join, quality, sharding, substring_dedup, suffix_dedup, token_output, url_filter
from weftline.llm.oracles import ORACLE_SQL  # noqa: F401  beside the queries, for the entry
from weftline.llm.shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(ids: bytes, decoded: str) -> tuple[str, str]:
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), keep_text=False, digest=digests, digest_fields=(("ids_sha256", "string"), ("decoded_sha256", "string"))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = url_filter.mined_rules(pages.join(bad, "page_id").select("url", "bad"))
    return url_filter.judge(pages, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all sequences written; ids of byte-level BPE, which keeps every byte; 50256 ends documents, 50257 fills up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, _ = token_output.write_shards(docs, tokenizer_path("byte_bpe_50k.tiktoken"), end_id=50256, pad_id=50257)
    return index.select("doc_id", "seq", "n_tokens", "slot", "shard", "offset", "crc32")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    return quality.score(docs, quality.fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_jaccard_join, op4_embedding_dedup, op5_substring_dedup, op6_suffix_dedup, op7_url_filter, op8_token_output, op9_quality, op10_decontamination)}
