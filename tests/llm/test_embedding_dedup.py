import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import embedding_dedup as E


def brute_force(rows):
    """Number of links and component of each vec_id, comparing all with all."""
    good = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            x = x / np.abs(x).max()
            good[i] = x / np.sqrt(x @ x)
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    comp = brute.components([i for i, _ in rows], links)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], comp[i]) for i in count}, len(links)


def result(df, **settings):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df, **settings).collect()}


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    wanted, links = brute_force([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = result(df)
    assert all(got[i][0] <= wanted[i][0] for i in wanted)  # exact cosines: no link below the threshold
    assert sum(n for n, _ in got.values()) / 2 >= 0.95 * links


def test_recall_at_the_threshold_and_tiles(spark):
    """Pairs at cosine 0.95 to 0.96, the hardest ones, with tiles of 4 vectors."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        a = rng.normal(size=24)
        a /= np.linalg.norm(a)
        b = rng.normal(size=24)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.951, 0.96)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted, links = brute_force(rows)
    got = result(df, tile=4)
    assert sum(n for n, _ in got.values()) / 2 >= 0.95 * links
    assert all(got[i][0] <= wanted[i][0] for i in wanted)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (4, [-1.0, -2.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 0.0]), (12, [1e-200, 2e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == brute_force(rows)[0]
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (4, [1.0, 2.0], 2, "y")], "vec_id long, embedding array<float>, n_links int, vec string")
    assert sorted((r["vec"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(odd).collect()) == [("x", 1, None, True), ("y", 1, None, False)]


def test_clashing_names(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(40)]
    rows += [(100 + k, (np.array(v) + 0.01).tolist()) for k, v in rows[:10]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    names = ["id", "comp", "rep", "m", "n", "u", "v", "a", "b", "vec", "t", "bucket", "buckets", "tiles", "task", "__id", "__row", "kept", "n_links", "x.y"]
    for n in names:
        df = df.withColumn(n, F.lit(n))
    out = E.near_duplicates(df).collect()
    expected, _ = brute_force(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == expected
    assert all(r[n] == n for r in out for n in names if n not in E.RESULTS)
