"""Writers: delimited text, several outputs of one parse, paths that clobber nothing."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import PipelineConfig
from weftline.functions import codec, names
from weftline.operators import links as L


def next_free_path(spark: SparkSession, path: str) -> str:
    """path, or path1, path2, ... if it is taken."""
    number, tried = 0, path
    while True:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tried)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return tried
        number += 1
        tried = f"{path}{number}"


def write_delimited(df: DataFrame, path: str, compression: str | None = None, single_file: bool = False, order: list | None = None) -> str:
    """Columns as text, joined by tabs, to a path that is free; returns it. Arrays of links and counts are encoded."""
    path = next_free_path(df.sparkSession, path)
    shown = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        shown.append(codec.encode_links(c) if kind.startswith("array<struct<lemma") else codec.encode_counts(c) if kind.startswith("array<struct<target:string,cnt") else F.coalesce(c.cast("string"), F.lit("")))
    if order:
        df = df.orderBy(*order)
    text = df.select(F.concat_ws("\t", *shown).alias("value"))
    (text.coalesce(1) if single_file else text).write.mode("errorifexists").text(path, compression=compression)
    return path


def write_dump(pages: DataFrame, path: str, config: PipelineConfig | None = None) -> dict[str, str]:
    """All relations of a page dump from one parse: pages, redirects, sentences, links, implicitlinks; returns their paths."""
    spark = pages.sparkSession
    config = config or PipelineConfig.of(spark)
    base = next_free_path(spark, path)
    title = names.format_resource_name(F.col("title"))
    named = pages.select(title.alias("title"), "redirect", "text")
    sentences = L.page_sentences(named.where(F.col("text").isNotNull()), config).persist(StorageLevel.MEMORY_AND_DISK)
    outputs = {
        "pages": named.select("title"),
        "redirects": named.where(F.col("redirect").isNotNull()).select("title", names.format_resource_name(F.col("redirect")).alias("to")),
        "sentences": sentences.select("text"),
        "links": L.explicit_links(sentences, config).select("text", "links"),
        "implicitlinks": L.all_links(sentences, config).select("text", "links"),
    }
    try:
        return {name: write_delimited(df, f"{base}/{name}") for name, df in outputs.items()}
    finally:
        sentences.unpersist()
