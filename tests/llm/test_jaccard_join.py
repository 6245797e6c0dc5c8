import random

import numpy as np

from tests.llm import brute
from weftline.llm import jaccard_join as J


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(df).collect()}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(df) == brute.jaccard_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_every_size_and_share(spark):
    """Copies with a few words changed: similarities on both sides of 0.8, at all sizes, chained and shuffled."""
    rnd = random.Random(11)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 30, 45, 70, 120, 300):
        for _ in range(4):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            for _ in range(5):
                rows.append((rnd.randrange(10**9), " ".join(words)))
                for _ in range(rnd.randrange(0, 1 + size // 20 + 1)):
                    words = list(words)
                    words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
                if rnd.random() < 0.5:
                    words = words[: max(1, int(len(words) * rnd.uniform(0.8, 1)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute.jaccard_components(rows)


def test_common_passage_does_not_link(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 60)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute.jaccard_components(rows)


def test_odd_tables(spark):
    assert J.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "A b c d e f g h"
    rows = [(None, text, 1), (5, text.lower(), 2), (5, "x y", 3), (6, "X\tY ", 4), (7, None, 5), (8, "", 6), (9, " \n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch int")
    out = sorted(((r["sketch"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(df).collect()))
    assert out == [(1, 4, None), (2, 4, None), (3, 1, None), (4, 1, None), (5, 0, 7), (6, 0, 8), (7, 0, 9)]


def test_pigeonhole_and_sketch_bounds():
    low = J.bands(5000)
    for a in range(1, 2000, 7):
        band = np.searchsorted(low, a, side="right") - 1
        d = J.differences(low[band + 1])
        for b in range(a, 5 * a // 4 + 1):
            assert (a + b) // 9 <= d < J.parts(d)


def test_folded_sketches_bound_the_difference():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(20, 300)).astype(np.uint64))
        b = np.union1d(a[: len(a) - rnd.integers(0, 4)], rnd.integers(0, 2**63, 3).astype(np.uint64))
        s = J.Sets.__new__(J.Sets)
        s.hash, s.first = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        differ, both = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
        if 9 * differ <= len(a) + len(b):
            assert J.may_link(len(a), len(b), s.sketch(0), s.sketch(1)), (differ, both)


def near_family(rnd, first_id, members, size, changes):
    """Near copies of one text, each with some words of its own: many pairs just above and just below 0.8."""
    words = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
    rows = []
    for k in range(members):
        mine = list(words)
        for _ in range(rnd.randrange(1, changes + 1)):
            mine[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
        rows.append((first_id + k, " ".join(mine)))
    return rows


def test_families_of_near_copies(spark, monkeypatch):
    """Small tiles and one pair a component: many rounds, components of several tiles, keys of few and of many members."""
    monkeypatch.setattr(J, "TILE", 8)
    rnd = random.Random(17)
    rows = near_family(rnd, 0, 60, 120, 3) + near_family(rnd, 1000, 40, 60, 2) + near_family(rnd, 2000, 50, 200, 6) + near_family(rnd, 3000, 30, 25, 1)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute.jaccard_components(rows)
    assert result(df) == expected
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(df, best=1).collect()} == expected
    assert 4 < len({c for _, c in expected.values()}) < len(rows)


def test_words_that_cancel_out_in_polynomials(spark):
    word = b"a"
    for _ in range(10):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba")).decode()
    rows = [(1, f"u v {word.decode()} x y"), (2, f"u v {other} x y"), (3, f"u v {other} x y")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == {1: (1, 1), 2: (1, 2), 3: (1, 2)}


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (2, b), (9, c), (9, ""), (4, c)]
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == {(5, 8): 2, (3, 8): 2, (2, 8): 2, (9, 8): 4, (9, 0): 4, (4, 8): 4}
