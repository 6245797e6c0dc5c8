import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import suffix_dedup as S


def result(df, **settings):
    out = S.suffix_dedup(df, **settings).withColumn("sha", F.sha2("kept", 256)).withColumn("spans", F.size("removed"))
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["spans"], r["sha"]) for r in out.collect()}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(df) == brute.byte_removal([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("together", [1024, 3])
def test_repeats_inside_and_across(spark, together):
    """With together=3 the windows of common anchors travel singly."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    line, base = noise(130), noise(700)
    rows = [(k, noise(rnd.randrange(0, 300)) + line + noise(rnd.randrange(0, 300))) for k in range(60)]
    rows += [(100, base), (101, base[50:400] + "x" + base[:180]), (102, base * 3), (103, "a" * 500), (104, "ab" * 200), (105, "a" * 99), (106, None), (107, ""), (108, base[:99]), (109, base[:100]), (110, "\x00" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, together=together) == brute.byte_removal(rows)


def test_odd_tables(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(chr(97 + k % 26) + str(k) for k in range(100))
    rows = [(None, text, 1), (7, text, 2), (7, text, 3), (9, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, other int".replace("kept int, ", "__block int, ").replace(", other int", ""))
    n = len(text)
    assert sorted((r["__block"], r["n_removed"]) for r in S.suffix_dedup(df).collect()) == [(1, 0), (2, n), (3, n), (4, 0)]


def test_suffix_array_and_groups_against_brute_force():
    rnd = random.Random(9)
    for _ in range(40):
        texts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(1, 6))]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.cumsum([0, *map(len, texts)])
        suffix = lambda i: texts[owner[i]][i - first[owner[i]] :]  # noqa: E731, B023
        order, lcp = S.enhanced_suffix_array(data, owner, np.arange(len(data)), 32)
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        inner = order - first[owner[order]]
        left = np.where(inner > 0, data[np.maximum(order - 1, 0)].astype(int), -1)
        found = {(n, frozenset(order[a:b].tolist())) for n, a, b in S.repeat_groups(order, lcp, left, 2)}
        wanted = set()
        for i in range(len(data)):
            for n in range(2, len(suffix(i)) + 1):
                where = [j for j in range(len(data)) if suffix(j)[:n] == suffix(i)[:n] and len(suffix(j)) >= n]
                nexts = [suffix(j)[n : n + 1] for j in where]
                lefts = [data[j - 1] if j > first[owner[j]] else None for j in where]
                if len(where) > 1 and (len(set(nexts)) > 1 or b"" in nexts) and (len(set(lefts)) > 1 or None in lefts):
                    wanted.add((n, frozenset(where)))
        assert found == wanted
