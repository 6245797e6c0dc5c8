from pyspark.sql import functions as F

from weftline.functions import dependencies as P
from weftline.schema import DEPENDENCY, TOKEN


def tokens(*pairs):
    return [{"begin": 0, "end": 0, "text": w, "pos": t, "lemma": w.lower()} for w, t in pairs]


def edges(*rows):
    return [{"gov": g, "dep": d, "type": t, "begin": 0, "end": 0} for g, d, t in rows]


TREE = tokens(("dogs", "NNS"), ("chase", "VB"), ("cats", "NNS"), ("because", "IN"), ("of", "IN"), ("fun", "NN"), ("in", "IN"))
EDGES = edges((1, 0, "nsubj"), (1, 2, "dobj"), (1, 4, "prep"), (4, 3, "mwe"), (4, 5, "pobj"), (5, 6, "prep"))


def frame(spark, t, d):
    return spark.createDataFrame([(t, d)], f"tokens array<{TOKEN}>, deps array<{DEPENDENCY}>")


def test_collapsed_prepositions(spark):
    out = frame(spark, TREE, EDGES).select(P.collapse_prepositions(F.col("deps"), F.col("tokens")).alias("d")).first()["d"]
    assert sorted((e["gov"], e["dep"], e["type"]) for e in out) == [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 5, "prep_because_of"), (5, 6, "prep")]
    assert frame(spark, [], []).select(P.collapse_prepositions(F.col("deps"), F.col("tokens")).alias("d")).first()["d"] == []


def test_features(spark):
    df = frame(spark, TREE, edges((1, 0, "nsubj"), (0, 0, "self")))
    assert sorted(df.select(P.bims(F.col("deps"), F.col("tokens"), F.lit(0)).alias("b")).first()["b"]) == ["nsubj(chase,@@)", "self(@@,dogs)", "self(dogs,@@)"]
    assert [(f["key"], f["values"], f["relation"], f["hole"]) for f in df.select(P.holing(F.col("deps"), F.col("tokens")).alias("h")).first()["h"]][:2] == [("chase", ["dogs"], "nsubj", 0), ("dogs", ["chase"], "nsubj", 1)]


def triples(t, d, patterns, **more):
    return [tuple(x.values()) for x in P.extract_triples(t, d, P.parse_patterns(patterns), **more)]


def test_triples():
    rules = "? ? ?\t* dep x*|because // never\nz y ?\t* subj *\n? y z\t* obj *"
    assert triples(TREE, EDGES, rules) == [("dogs", "chase", "cats")] * 2  # noted again after the next child
    assert triples(TREE, EDGES, "z y ?\t* subj dog*\n? * z\t*#v* dobj *#n*") == [("dogs", None, "cats")] * 2
    assert triples(TREE, EDGES, "? ? ?\t* arg *\n" + rules) == []  # a veto on all arguments, by the hierarchy
    assert triples(TREE, EDGES, "x y z\t* pobj *") == [("chase", "of", "fun")]
    assert triples(TREE, edges((1, 0, "nsubj"), (1, 2, "prep_in")), "z y ?\t* nsubj *\n? y z\t* prep_in *") == [("dogs", "chase", "cats")]


def test_proper_nouns_depth_and_loops():
    named = tokens(("x", "VB"), ("Anna", "NNP"), ("b", "NN"), ("c", "NN"))
    assert triples(named, edges((0, 1, "nsubj"), (1, 2, "nsubj"), (1, 3, "dobj")), "z y ?\t* subj *\n? y z\t* obj *") == []
    chain = tokens(*((f"w{k}", "NN") for k in range(15)))
    deep = edges(*((k, k + 1, "dobj") for k in range(14)))
    assert triples(chain, deep, "y * z\t* dobj *") == []
    assert len(triples(chain, deep, "y * z\t* dobj *", max_depth=20)) == 14
    assert triples(chain, edges((0, 1, "dobj"), (1, 0, "dobj")), "y * z\t* dobj *") == []
    assert triples(chain[:2], edges((0, 1, "dobj"), (0, 0, "dobj")), "y * z\t* dobj *") == [("w0", None, "w1")]


def test_pattern_errors():
    import pytest

    with pytest.raises(ValueError):
        P.parse_patterns("a b\t* * *")
    assert P.parse_patterns("\n// only a comment\n") == []
