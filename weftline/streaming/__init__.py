"""An extension: dictionary counts that follow a stream of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def surface_form_counts(mentions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps (lemma, target, cnt) up to date: each batch's counts are added under its number, a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("lemma", "target").agg(F.count("*").alias("cnt")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mentions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_counts(mentions_path: DataFrame) -> DataFrame:
    """The sums over all batches written so far."""
    return mentions_path.groupBy("lemma", "target").agg(F.sum("cnt").alias("cnt"))
