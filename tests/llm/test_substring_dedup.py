import random

from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import substring_dedup as S


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in S.substring_dedup(df).withColumn("sha", F.sha2("kept", 256)).collect()}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(df) == brute.substring_removal([(r["doc_id"], r["text"]) for r in df.collect()])


def test_overlaps_inside_and_across(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    base = [rnd.choice(words) for _ in range(90)]
    rows = [(1, " ".join(base)), (2, " ".join(base[5:60] + ["x"] + base[:40])), (3, "a " * 50), (4, " ".join(["a"] * 25)), (5, None), (6, ""), (7, "  \t\n"), (8, " ".join(base[:19])), (9, " ".join(base) * 3), (10, "é " * 30 + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute.substring_removal(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_dedup(empty).count() == 0
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(None, text, 1, "a", "b"), (7, text, None, "a", None), (7, text, 3, None, "b"), (9, None, 4, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_words` int, __id string, `a.b` string")
    out = {(r["doc_id"], r["__id"], r["a.b"]): (r["n_removed"], r["kept"]) for r in S.substring_dedup(df).collect()}
    assert out == {(None, "a", "b"): (0, text), (7, "a", None): (40, ""), (7, None, "b"): (40, ""), (9, "a", "b"): (0, "")}


def test_equal_ids_do_not_remove_each_other(spark):
    text = " ".join(f"k{i}" for i in range(40))
    df = spark.createDataFrame([(7, text), (7, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in S.substring_dedup(df).collect()] == [0, 0]


def test_words_that_cancel_out_in_polynomials(spark):
    word = b"a"
    for _ in range(10):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    words = [f"k{i}" for i in range(20)]
    rows = [(1, " ".join([*words[:7], word.decode(), *words[7:]])), (2, " ".join([*words[:7], word.translate(bytes.maketrans(b"ab", b"ba")).decode(), *words[7:]]))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute.substring_removal(rows)


def test_long_text(spark):
    """Read in slices of a megabyte, cut between words."""
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(10**7)}" for _ in range(450_000))
    rows = [(1, text), (2, text[1000:9000] + " x " + text[-3000:]), (3, "y" * 3_000_000 + " " + text[:500])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute.substring_removal(rows)
