"""Extra columns that are named like anything an operator uses inside pass through every operator."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, jaccard_join, quality, sharding, substring_dedup, suffix_dedup
from weftline.llm.queries import tokenizer_path

NAMES = (
    "__at __block __id __row __text __key __sub __before __rank __later id ids n rep sig1 sig2 again keys key shingles sketch hub c a b u v m comp label later task tile own other pair "
    "bucket buckets packed bits classes places check hash doc start place first block part stats y fold sums bin ones size rows shard_ slot_ hits_ begin end item items bytes x s k t none"
).split()
TEXT = " ".join(f"w{k}" for k in range(40))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, TEXT), (2, TEXT + " x"), (3, None), (4, ""), (5, "other words here " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for n in NAMES:
        df = df.withColumn(n, F.lit(n))
    return df


def fitted(spark, table):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0)], "doc_id long, quality int")
    return quality.fit(table, labels)


OPERATORS = {
    "op1": lambda spark, df: bpe.encode(df, tokenizer_path()),
    "op2": lambda spark, df: sharding.shard(df),
    "op3": lambda spark, df: jaccard_join.jaccard_join(df),
    "op5": lambda spark, df: substring_dedup.substring_dedup(df),
    "op6": lambda spark, df: suffix_dedup.suffix_dedup(df),
    "op9": lambda spark, df: quality.score(df, fitted(spark, df)),
    "op10": lambda spark, df: decontaminate.decontaminate(df, spark.createDataFrame([("i", TEXT)], "item_id string, text string")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_other_columns_pass_through(spark, table, name):
    rows = OPERATORS[name](spark, table).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 5]
    replaced = {"op1": {"ids"}, "op2": {"size"}}.get(name, set())
    assert all(r[n] == n for r in rows for n in NAMES if n not in replaced)
