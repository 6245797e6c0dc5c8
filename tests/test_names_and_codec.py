from pyspark.sql import functions as F

from weftline.functions import codec, names
from weftline.operators import redirects


def test_redirects_and_fragments(spark):
    led = spark.createDataFrame([("a", "foo#1"), ("b", "bar")], "source string, destination string")
    cases = [
        ("a", False, "foo"), ("a", True, "foo#1"), ("a#2", False, "foo"), ("a#2", True, "foo#2"), ("a#", True, "foo#1#"),
        ("b", False, "bar"), ("b", True, "bar"), ("b#2", False, "bar"), ("b#2", True, "bar#2"), ("c#2", False, "c"), ("c#2", True, "c#2"), ("c", True, "c"), ("", True, ""),
    ]
    # An empty fragment is a fragment here: "#" alone stands behind what the redirect leads to, without the redirect's own.
    cases[4] = ("a#", True, "foo#")
    df = spark.createDataFrame([(t, k, e) for t, k, e in cases], "target string, keep boolean, expected string")
    for keep in (False, True):
        for r in redirects.resolve(df.where(F.col("keep") == keep), led, keep_fragment=keep).collect():
            assert r["resolved"] == r["expected"], r
    assert [r["resolved"] for r in redirects.resolve_verbatim(df.where("target = 'a#2'").limit(1), led).collect()] == ["a#2"]


def test_resource_names(spark):
    given = ["ab cd", "ßx y", "éa b", "", "A", " x", "\U0001042ax", "ŉx", "a\U0001f600b"]
    df = spark.createDataFrame([(g,) for g in given], "n string")
    out = df.select(names.format_resource_name(F.col("n")), names.utf16_length(F.col("n")), names.legacy_name(F.col("n"))).collect()
    assert [r[0] for r in out] == ["Ab_cd", "ßx_y", "Éa_b", "", "A", "_x", "\U0001042ax", "ŉx", "A\U0001f600b"]
    assert [r[1] for r in out] == [len(g.encode("utf-16-be")) // 2 for g in given] and out[0][2] == "ab_cd"


def test_links_with_and_without_lemmas(spark):
    lines = ["Cars@@Automobile@0:4  motor cycles@@Motorbike@22:33", "Automobile@0:4  Motorbike@22:33", "a@b@1:2  bad  x@1:  y@@z@w@3:99999999999", ""]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(codec.decode_links(F.col("l")).alias("links"))
    out = [[tuple(x) for x in r["links"]] for r in df.collect()]
    assert out == [[("Cars", "Automobile", 0, 4), ("motor cycles", "Motorbike", 22, 33)], [(None, "Automobile", 0, 4), (None, "Motorbike", 22, 33)], [(None, "a@b", 1, 2)], []]
    again = df.select(codec.encode_links(F.col("links")).alias("t")).collect()
    assert [r["t"] for r in again][:2] == lines[:2]


def test_counts_columns_and_numbers(spark):
    df = spark.createDataFrame([("A:B:12", "a\t\tb\t\t", " 5 "), ("x", "a", "+7"), (":3", "", "5.7")], "c string, l string, n string")
    out = df.select(codec.decode_count(F.col("c")).alias("c"), F.size(codec.columns_of(F.col("l"))).alias("k"), codec.whole(F.col("n")).alias("n")).collect()
    assert [r["c"] and tuple(r["c"]) for r in out] == [("A:B", 12), None, ("", 3)] and [r["k"] for r in out] == [3, 1, 1] and [r["n"] for r in out] == [None, 7, None]


def test_documents_of_lines(spark):
    doc = "Cars and motor cycles\tCars@@Automobile@0:4  motor cycles@@Motorbike@9:21\nno links here\nOn rails\tTrain@3:8  bad@x\t"
    r = spark.createDataFrame([(doc,)], "d string").select(codec.document_text(F.col("d")).alias("t"), codec.document_links(F.col("d")).alias("l")).first()
    assert r["t"] == "Cars and motor cycles\nOn rails\n"
    assert [(r["t"][x["begin"] : x["end"]], x["resource"]) for x in r["l"]] == [("Cars", "Automobile"), ("motor cycles", "Motorbike"), ("rails", "Train")]
