import pytest
from pyspark.sql import functions as F

from weftline.config import PipelineConfig
from weftline.operators import dictionary as D
from weftline.operators import evaluate as E
from weftline.operators import filters, sampling
from weftline.operators import statistics as S
from weftline.plans import bindings as B

DIR = "/root/testdata/sf0.001"


def test_sense_inventory_edges(spark):
    rows = [("few", "a", 3), ("few", "b:c", 1)] + [("flat", f"t{k:02}", 1) for k in range(25)] + [("tie", "z", 50), ("tie", "y", 50), ("tie", "x", 9)]
    df = spark.createDataFrame(rows, "lemma string, target string, cnt long")
    out = {r["lemma"]: (r["total"], r["num_senses"], [tuple(t) for t in r["targets"]]) for r in D.sense_inventory(df, 10).collect()}
    assert out == {"few": (4, 2, [("a", 3), ("b:c", 1)]), "flat": (25, 0, []), "tie": (109, 2, [("y", 50), ("z", 50)])}
    assert {r["lemma"]: r["num_senses"] for r in D.sense_inventory(df).collect()} == {"few": 2, "flat": 25, "tie": 3}


def test_samples_keep_their_bounds(spark):
    m = B.mentions(spark, DIR).withColumnRenamed("lemma", "word")
    m = m.union(spark.createDataFrame([(1, "lonely", "t"), (2, "lonely", "t")], m.schema))
    senses, again = sampling.sample_senses(m), sampling.sample_senses(m.repartition(7))
    assert sorted(senses.collect()) == sorted(again.collect())
    assert sorted(sampling.sample_senses(m, seed=1).collect()) != sorted(senses.collect())
    assert senses.groupBy("word", "target").count().agg(F.max("count")).first()[0] <= 3
    assert senses.groupBy("word").agg(F.count_distinct("target").alias("n")).agg(F.max("n")).first()[0] <= 10
    words = sampling.sample_per_word(m, senses)
    assert words.groupBy("word").count().agg(F.max("count")).first()[0] <= 5
    assert words.join(senses, ["word", "sid"], "left_semi").count() == 0
    assert senses.where("word = 'lonely'").count() == words.where("word = 'lonely'").count() == 0
    assert senses.join(m, ["word", "target", "sid"], "left_anti").count() == 0


def test_zero_bucket_may_be_negative(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 2)], "resource string, cnt long")
    pages, led = spark.createDataFrame([("a",), ("b",)], "resource string"), spark.createDataFrame([("r", "a")], "source string, destination string")
    assert sorted(map(tuple, S.histogram_with_zero(counts, pages, led).collect())) == [(0, -1), (2, 2)]


def test_whitelists_agree(spark):
    m = B.mentions(spark, DIR)
    words = ["red anvil", "blue rod@@Brand#1", "blue rod@@Brand#3", "hot ring", "hot ring@@Brand#1", "none"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted(filters.whitelisted(m, words).collect()) == sorted(filters.whitelisted_by(m, table).collect())
    assert PipelineConfig(filter_words=" a, b@@c ,,").whitelist == ["a", "b@@c"]


def test_surface_texts(spark):
    rows = [(1, "red car and bus", [(None, "Car", 4, 7), (None, "Bus", 12, 15)]), (2, "a car", [(None, "Car", 2, 5)]), (3, "x", [])]
    df = spark.createDataFrame(rows, "sid int, sentence string, links array<struct<lemma:string,target:string,begin:int,end:int>>")
    out = filters.by_surface_text(df, spark.createDataFrame([("bus",), ("bus",), ("red",)], "word string")).collect()
    assert [(r["sid"], [x["target"] for x in r["links"]]) for r in out] == [(1, ["Bus"])]


def test_evaluation(spark):
    rows = [(0, "w", 1, "a"), (0, "w", 1, "a"), (1, "w", 1, "a"), (1, "w", 2, "b"), (2, "w", 2, "b"), (2, "w", None, "a"), (2, "v", 1, "c")]
    df = spark.createDataFrame(rows, "fold int, word string, cluster_id int, gold string")
    out = {(r["fold"], r["word"], r["cluster_id"], r["gold"]): (r["baseline"], r["cluster_sense"], r["sense"]) for r in E.predictions(df).collect()}
    assert out == {(0, "w", 1, "a"): ("a", "a", "a"), (1, "w", 1, "a"): ("a", "a", "a"), (1, "w", 2, "b"): ("a", "b", "b"), (2, "w", 2, "b"): ("a", "b", "b"), (2, "w", None, "a"): ("a", None, "a"), (2, "v", 1, "c"): (None, None, None)}
    m = E.metrics(E.predictions(df)).first().asDict()
    assert (m["instances"], m["correct"], m["unanswered"], m["correct_by_fallback"], m["cluster_without_sense"]) == (7, 6, 1, 1, 1)


def test_clusters_by_shared_features(spark):
    contexts = spark.createDataFrame([(1, "w", "x"), (1, "w", "x"), (1, "w", "y"), (2, "w", "q"), (3, "w", "y")], "iid int, word string, feature string")
    clusters = spark.createDataFrame([("w", 1, "x", 2.0), ("w", 2, "y", 1.0), ("w", 3, "y", 1.0), ("v", 4, "q", 9.0)], "word string, cluster_id int, feature string, weight float")
    assert sorted(map(tuple, E.choose_cluster(contexts, clusters).collect())) == [(1, 1, 2.0), (3, 2, 1.0)]
    tokens = spark.createDataFrame([([(0, 2, "ab", "NN", "ab"), (3, 4, "c", "NN", "c"), (5, 7, "ab", "NN", "ab")],)], "t array<struct<begin:int,end:int,text:string,pos:string,lemma:string>>")
    r = tokens.select(E.head_word("t", F.lit(3), F.lit(4)).alias("h"), E.head_word("t", F.lit(0), F.lit(4)).alias("n"), E.context_lemmas("t", F.lit("c")).alias("c")).first()
    assert (r["h"], r["n"], r["c"]) == ("c", None, ["ab"])


def test_word_lists(spark):
    words = spark.createDataFrame([("The", 9), ("a b", 8), ("cat", 7), ("dog", 7), ("eel", 1)], "word string, cnt long")
    assert [r["word"] for r in filters.word_list_slice(words, 1, 2).collect()] == ["cat", "dog"]
    assert {r["word"] for r in filters.mid_frequency(words, 7, 2).collect()} == {"cat", "dog"}


@pytest.mark.parametrize("name", ["surface_form_dictionary", "sample_per_sense", "clean_markup"])
def test_plans_read_few_columns_and_stay_native(spark, name):
    from weftline.plans.catalog import QUERIES

    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    assert "l_comment" not in plan and ("l_extendedprice" not in plan)


def test_equal_instances_may_be_counted(spark):
    rows = [(0, "w", 1, "a"), (0, "w", 1, "a"), (1, "w", 1, "a"), (1, "w", 2, "b"), (2, "w", 2, "b"), (2, "w", 2, "b"), (2, "w", None, "a"), (2, "w", None, "a"), (2, "v", 1, "c")]
    df = spark.createDataFrame(rows, "fold int, word string, cluster_id int, gold string")
    whole, few = E.metrics(E.predictions(df)), E.metrics(E.predictions(E.counted(df)))
    assert E.counted(df).count() == 6 and whole.dtypes == few.dtypes and whole.collect() == few.collect()
    assert E.metrics(E.predictions(E.counted(df.where("fold > 9")))).first()["correct"] == 0


def test_instances_keep_their_cluster_or_none(spark):
    instances = spark.createDataFrame([("i", 0, "w", "a", ["x", "y"]), ("j", 1, "w", "b", ["q"]), ("k", 1, "w", "b", []), ("l", 2, "w", "b", ["y"])], "iid string, fold int, word string, gold string, context array<string>")
    clusters = spark.createDataFrame([("w", 1, "x", 2), ("w", 2, "y", 1), ("w", 3, "y", 1), ("v", 4, "q", 9)], "word string, cluster_id int, feature string, weight int")
    assert sorted(map(tuple, E.clustered_instances(instances, clusters).collect())) == [("i", 0, "w", 1, "a"), ("j", 1, "w", None, "b"), ("k", 1, "w", None, "b"), ("l", 2, "w", 2, "b")]
