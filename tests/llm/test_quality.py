import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from weftline.llm import quality as Q
from weftline.llm.queries import op9_quality


def test_held_out_accuracy(spark):
    out = {r["doc_id"]: r for r in op9_quality(spark, "/root/testdata/sf0.01").collect()}
    docs = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert set(out) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    test = [(r["predicted"], labels[d]) for d, r in out.items() if r["held_out"] and d in labels]
    good = [p for p, y in test if y == 1]
    bad = [p for p, y in test if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), min_size=1, max_size=30))
def test_isotonic_is_the_nearest_monotone_sequence(points):
    v, w = np.array([p for p, _ in points]), np.array([float(n) for _, n in points])
    out = Q.isotonic(v, w)
    assert len(out) == len(v) and (np.diff(out) >= -1e-12).all()
    # The max-min formula of isotonic regression.
    mean = lambda a, b: (v[a:b] * w[a:b]).sum() / w[a:b].sum()
    wanted = [max(min(mean(a, b) for b in range(k + 1, len(v) + 1)) for a in range(k + 1)) for k in range(len(v))]
    assert np.allclose(out, wanted)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "good words here", None), (3, "\x00" * 10, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, constant in ((none, 0.5), (spark.createDataFrame([(2, 1), (3, None), (9, 0)], none.schema), 1.0)):
        model = Q.fit(docs, labels)
        assert model.constant == constant
        assert [r["score"] for r in Q.score(docs, model).collect()] == [constant] * 4
    model = Q.fit(docs, spark.createDataFrame([(2, 1), (3, 0), (3, 0)], none.schema))
    assert all(0 <= r["score"] <= 1 for r in Q.score(docs, model).collect())
    assert Q.score(docs.limit(0), model).count() == 0


def test_statistics_do_not_depend_on_the_batch(spark):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + [b"", b"\n", "é!".encode()]
    whole = Q.statistics(texts)
    assert np.allclose(whole, np.vstack([Q.statistics([t]) for t in texts])) and np.isfinite(whole).all()
