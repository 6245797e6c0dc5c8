from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import decontaminate as D


def result(docs, items, **settings):
    out = D.decontaminate(docs, items, **settings).withColumn("sha", F.sha2(F.array_join("item_ids", ","), 256))
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["sha"], r["n_hit"] > 0) for r in out.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    wanted = brute.contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sum(x[4] for x in wanted.values()) > 5
    assert result(docs, items) == wanted
    assert result(docs, items, max_patterns=300) == wanted  # several automata


def test_odd_items_and_texts(spark):
    items = [(1, "One two, three"), (10, "one TWO three"), (2, None), (3, "  ,.! "), (4, "été café " + "w " * 12), (5, "x")]
    docs = [(1, "zero one-two/three four"), (2, "one two threefour"), (3, None), (4, ""), (5, "ÉTÉ été CAFé café " + "W " * 30), (6, "X\nx_x"), (7, "one two three one two three"), (8, "y" * 100_000 + " x")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(d, i) == brute.contamination(docs, items)
    assert all(x[1:3] == (0, 0) for x in result(d, i.limit(0)).values())
    assert D.decontaminate(d.limit(0), i).count() == 0
    row = D.decontaminate(d.withColumn("hits", F.lit(1)).where("doc_id = 1"), i).first()
    assert [row["text"][h["begin"] : h["end"]] for h in row["hits"]] == ["one-two/three"] and row["item_ids"] == ["1", "10"]
