from pyspark.sql import functions as F

from weftline.llm import url_filter as U
from weftline.llm.queries import op7_url_filter


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([k for k in map(path.find, "?#") if k >= 0], default=len(path))]


def owner(host, path):
    fits = [(len(h) + len(p), what == "block", h + p, what) for what, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_every_page(spark):
    rows = op7_url_filter(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path = plain(pages[r["page_id"]])
        rule, what = owner(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (what or ("block" if r["mined_rule"] else "allow"))


def test_urls_of_all_shapes(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "x://y://b.net/p", "http://example.net/en/x", "http://sub.example.net/en/", "http://notexample.net/en/", "http://example.com?q=/de/", "http://example.com/de/#f", "http://a.org/fr/", "http://ÄÖ.ORG/fr/x?y", "http://net/", "http://a.net#/x", "http://a.net\n/x", "http://u@h:80/p"]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    for r in U.judge(df, []).collect():
        host, path = plain(urls[r["page_id"]])
        rule, what = owner(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, what or "allow"), urls[r["page_id"]]


def test_mined_rules_block_what_the_labels_show(spark):
    rows = []
    for k in range(200):
        rows.append((f"http://shop{k % 7}.pills.example/buy/{k}", k % 10 != 0))
        rows.append((f"http://news{k % 5}.paper.example/read/{k}", k % 20 == 0))
        rows.append((f"http://mix.example/{'buy' if k % 2 else 'read'}/{k}?ref=x", False))
    rows.append((None, True))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    mined = U.mine(df)
    assert mined and all(r.confidence >= U.MIN_CONFIDENCE for r in mined)
    # Brute force: each rule's figures recounted, and each url's verdict.
    seen = [({t for t in r["t"]}, r["bad"], r["url"]) for r in df.withColumn("t", U.tokens_of(U.host_of(df.url), U.path_of(df.url), df.url)).collect()]
    for rule in mined:
        having = [bad for tokens, bad, _ in seen if set(rule.tokens) <= tokens]
        assert abs(sum(having) / len(having) - rule.confidence) < 1e-9
    verdicts = {r["url"]: r["verdict"] for r in U.judge(df.drop("bad"), mined, rules=()).collect()}
    for tokens, _, url in seen:
        assert verdicts[url] == ("block" if any(set(r.tokens) <= tokens for r in mined) else "allow")
    assert verdicts["http://shop3.pills.example/buy/3"] == "block" and verdicts["http://news1.paper.example/read/1"] == "allow"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert U.mine(empty) == []
    assert U.mine(spark.createDataFrame([("http://a.b/c", True)], "url string, bad boolean")) == []
    assert U.judge(empty.drop("bad"), []).count() == 0


def planted(spark):
    """Three sure patterns of 12 tokens, 12,285 rules before pruning, and one pattern of lower confidence."""
    rows = [(f"http://sure{p}.p{p}.q{p}.example/a{p}/b{p}/c{p}/d{p}/?x{p}=1", True) for p in range(3) for _ in range(10)]
    rows += [("http://less.test/only/here", k % 10 != 0) for k in range(20)]
    rows += [(f"http://fine{k % 9}.test/ok/{k}", False) for k in range(200)]
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_sure_patterns_with_many_subsets_hide_no_other_rule(spark):
    df = planted(spark)
    mined = U.mine(df)
    tokens = {r["url"]: set(r["t"]) for r in df.withColumn("t", U.tokens_of(U.host_of(df.url), U.path_of(df.url), df.url)).distinct().collect()}
    less = [r for r in mined if set(r.tokens) <= tokens["http://less.test/only/here"]]
    assert less and all(abs(r.confidence - 0.9) < 1e-9 for r in less)
    # No kept rule has another among its tokens that does as well.
    assert not any(set(a.tokens) < set(b.tokens) and a.confidence >= b.confidence for a in mined for b in mined)
    verdicts = {r["url"]: r["verdict"] for r in U.judge(df.select("url"), mined, rules=()).collect()}
    assert {u for u, v in verdicts.items() if v == "block"} == {u for u in verdicts if "sure" in u or "less" in u}


def test_pruning_sees_past_combinations_that_are_no_rules(spark):
    rules = [(["a"], 0.9), (["b", "c"], 0.7), (["b", "c", "d"], 0.8), (["a", "b", "c"], 0.8), (["b", "c", "e"], 0.7), (["b", "c", "d", "e"], 0.8), (["a", "b", "c", "d"], 0.95)]
    kept = U._pruned(spark.createDataFrame([(t, c, 0.1) for t, c in rules], U.RULE_SCHEMA))
    assert sorted(tuple(r["tokens"]) for r in kept.collect()) == [("a",), ("a", "b", "c", "d"), ("b", "c"), ("b", "c", "d")]


def test_rules_in_a_table_that_is_not_broadcast(spark, monkeypatch):
    df = planted(spark)
    rules = U.mined_rules(df)
    few = U.judge(df.select("url"), rules, rules=()).collect()
    monkeypatch.setattr(U, "FEW_RULES", 0)
    assert sorted(few) == sorted(U.judge(df.select("url"), rules, rules=()).collect())


def test_long_paths_do_not_multiply(spark):
    """30 segments that always come together are one item to the miner, and each of them tells a url."""
    path = "/".join("s" + chr(97 + k // 10) + chr(97 + k % 10) for k in range(30))
    rows = [(f"http://long.test/{path}/?q=1", True)] * 20 + [(f"http://fine{k % 9}.test/ok/{k}", False) for k in range(100)]
    rules = U.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert rules.count() == 1 and len(rules.first()["classes"][0]) > 30
    pages = spark.createDataFrame([(f"http://elsewhere.test/{x}",) for x in ("saa", "x/scj", "ok", "sdd")], "url string")
    assert [r["verdict"] for r in U.judge(pages, rules, rules=()).orderBy("url").collect()] == ["allow", "block", "allow", "block"]


def test_the_query_blocks_by_mined_rules(spark, tmp_path):
    """As registered, over tables in which labels do relate to urls: verdicts of all urls without an owner's rule come from mined rules."""
    urls = [f"http://shop{k % 7}.pills.test/buy/{k}" if k % 3 == 0 else f"http://news{k % 5}.paper.test/read/{k}" for k in range(600)] + ["http://a.net/buy/1", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(0, 600, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["page_id"]: r for r in op7_url_filter(spark, str(tmp_path)).collect()}
    assert len(rows) == 602
    for k in range(600):
        assert (rows[k]["verdict"], rows[k]["rule"]) == ("block" if k % 3 == 0 else "allow", None)
        assert (rows[k]["mined_rule"] is not None) == (k % 3 == 0)
    assert (rows[600]["verdict"], rows[600]["rule"]) == ("block", "net/") and rows[601]["verdict"] == "allow"


def test_clashing_names(spark):
    names = ["best", "token", "need", "confidence", "item", "has", "tokens", "verdict", "host", "path", "rule", "mined_rule", "__row", "__url", "__tokens", "__mined", "__verdict", "filed", "a.b"]
    df = planted(spark).select("url").distinct()
    for n in names:
        df = df.withColumn(n, F.lit(n))
    rules = U.mined_rules(planted(spark))
    out = U.judge(df, rules, rules=()).collect()
    assert len(out) == df.count() and {r["best"] for r in out} == {"best"} and {r["__row"] for r in out} == {"__row"} and {r["a.b"] for r in out} == {"a.b"}
    assert all((r["verdict"] == "block") == ("sure" in r["url"] or "less" in r["url"]) for r in out)
