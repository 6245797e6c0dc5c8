"""URL filters: allow and block rules of the operator's owner, and association rules mined from labels.

A url's tokens are its host's labels and suffixes, path segments and query keys. Spark's FP-growth
mines token combinations over labelled urls, each basket of a bad one with a token for its label.
Tokens that stand in the very same labelled urls are one class, mined as one item, and any of them
stands for it in a rule: so long paths do not multiply into all subsets of their segments. An
association rule "tokens -> bad" counts if it has the support, the confidence and the lift asked
for, and no rule on fewer of its tokens does as well (pruning). All such rules are kept, in a table
in the shared folder. They are pruned from short to long and matched by an inverted index: a rule is
filed under its rarest item, a url's items are joined with the index (broadcast if it was counted
to be small), and a rule fires if the url has all its tokens.

The owner's rules come first: a rule (host, path) fits its host and all subdomains where the url's
path starts with the rule's; the longest wins (host and path characters together; block before
allow between equals). Urls without a fitting rule get the method's verdict.

Defined cases: a null url or one without :// has an empty host and path, has no tokens and is
allowed; repeated urls are judged alike; urls of any length are read whole; with no labels, one class or an empty table nothing is
mined and all other urls are allowed; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import materialize, others, partitions, quoted

RESULTS = ("host", "path", "rule", "verdict", "mined_rule")
#: The owner's rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MAX_FIT = 0.0005, 0.6, 2.0, 1_000_000
BAD = "label:bad"
#: So many rules at most are broadcast.
FEW_RULES = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; "" without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url):
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host, path, url):
    """Distinct tokens: each host label, each host suffix of two labels or more, path segments, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.size(labels) - k >= 1), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    named = F.transform(labels, lambda x: F.concat(F.lit("label of host:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(named, suffixes, segments, F.coalesce(keys, F.array().cast("array<string>")))))


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


RULE_SCHEMA = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("support", T.DoubleType())])


def mine(urls: DataFrame, **settings) -> list[MinedRule]:
    """The rules of mined_rules at the driver, for labels that give few, with every choice of a token of each class; fewest tokens first."""
    found = mined_rules(urls, **settings)
    rows = [] if found is None else found.collect()
    each = [MinedRule(tuple(sorted(tokens)), r["confidence"], r["support"]) for r in rows for tokens in product(*r["classes"])]
    return sorted(each, key=lambda r: (len(r.tokens), r.tokens))


def _classes(items: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that `least` baskets (id, tokens) have or more: item is the first of all tokens that stand in the same baskets.

    Baskets are told apart by the sums of two 64-bit hashes of their numbers.
    """
    each = items.select("id", F.explode("tokens").alias("token"))
    where = each.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where(F.col("c") >= least)
    first = where.groupBy("c", "x", "y").agg(F.collect_set("token").alias("all"))
    return first.select(F.explode("all").alias("token"), F.array_min("all").alias("item"))


def mined_rules(urls: DataFrame, *, url_col: str = "url", bad_col: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_fit: int = MAX_FIT) -> DataFrame | None:
    """(tokens, classes, confidence, support): all rules of labelled urls (bad_col true or false), or None without any; about max_fit urls at most, drawn with a fixed seed.

    tokens are items; classes has for each of them, in the same order, the tokens that stand for it.
    """
    url = F.col(quoted(url_col))
    labelled = urls.where(F.col(quoted(bad_col)).isNotNull()).select(url.alias("u"), F.col(quoted(bad_col)).alias("bad"))
    n = labelled.count()
    if n > max_fit:
        labelled = labelled.sample(max_fit / n, seed=7)
    baskets = materialize(labelled.select(F.monotonically_increasing_id().alias("id"), tokens_of(host_of(F.col("u")), path_of(F.col("u")), F.col("u")).alias("tokens"), "bad"), "op7-baskets")
    told = baskets.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).first()
    if not told["n"] or not told["bad"] or told["bad"] == told["n"]:
        return None
    least = max(math.ceil(min_support * told["n"]), 5)
    classes = materialize(_classes(baskets, least), "op7-classes")
    items = baskets.select("id", "bad", F.explode("tokens").alias("token")).join(classes, "token").groupBy("id", "bad").agg(F.collect_set("item").alias("items"))
    items = materialize(items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "op7-items")
    held = items.count()
    if not held:
        return None
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, numPartitions=partitions(urls.sparkSession)).fit(items)
    # Spark mines anew at every use of the sets.
    sets = materialize(model.freqItemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq").where(F.size("tokens") > 0), "op7-sets")
    both, alone = sets.where("bad").select("tokens", F.col("freq").alias("both")), sets.where("not bad").select("tokens", "freq")
    sure = both.join(alone, "tokens").select("tokens", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / told["n"]).alias("support"))
    rules = _pruned(materialize(sure.where((F.col("confidence") >= min_confidence) & (F.col("confidence") / (told["bad"] / told["n"]) >= min_lift)), "op7-sure"))
    if rules is None:
        return None
    named = classes.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("class"))
    spread = rules.select("tokens", F.posexplode("tokens").alias("k", "item")).join(named, "item").groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("k", "class"))).alias("all"))
    return materialize(rules.join(spread.select("tokens", F.transform("all", lambda x: x["class"]).alias("classes")), "tokens").select("tokens", "classes", "confidence", "support"), "op7-rules")


def _filed(rules: DataFrame) -> DataFrame:
    """rules, each with the one of its tokens that the fewest of them have."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(often, "token").groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("filed"))
    return rules.join(rarest, "tokens")


def _pruned(rules: DataFrame) -> DataFrame | None:
    """rules without those for which one on fewer of their tokens has their confidence, or more; None without any.

    A rule that goes has a kept one in its place that does as well, so that rules are held against shorter kept ones alone.
    """
    sizes = sorted(r[0] for r in rules.select(F.size("tokens")).distinct().collect())
    if not sizes:
        return None
    filed, kept = materialize(_filed(rules), "op7-filed"), None
    for k in sizes:
        level = filed.where(F.size("tokens") == k)
        if kept is not None:
            shorter = kept.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"), F.col("filed").alias("token"))
            pairs = level.select("tokens", "confidence", F.explode("tokens").alias("token")).join(shorter, "token")
            level = level.join(pairs.where((F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct(), "tokens", "left_anti")
        level = materialize(level, "op7-kept")
        kept = level if kept is None else kept.unionByName(level)
    return kept.select("tokens", "confidence", "support")


def judge(pages: DataFrame, mined: DataFrame | list[MinedRule] | None, *, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """pages with host, path, rule (the owner's rule that decides, or null), verdict and mined_rule (tokens of the rule that blocked, or null)."""
    spark = pages.sparkSession
    carried = others(pages, *RESULTS)
    url = F.col(quoted(url_col)).cast("string")
    host, path = host_of(url), path_of(url)
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in carried)) if carried else F.lit(None)
    read = pages.select(row.alias("__row"), url.alias("__url"), host.alias("host"), path.alias("path"))
    decided = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    # Longest last, so that its branch is outermost.
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1], r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        decided, verdict = F.when(fits, F.lit(h + p)).otherwise(decided), F.when(fits, F.lit(what)).otherwise(verdict)
    read = read.withColumns({"rule": decided, "__verdict": verdict})
    if isinstance(mined, list):
        mined = spark.createDataFrame([(list(r.tokens), r.confidence, r.support) for r in mined], RULE_SCHEMA) if mined else None
    back = [F.col("__row")[c].alias(c) for c in carried]
    if mined is None:
        return read.select(*back, "host", "path", "rule", F.coalesce("__verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined_rule"))
    if "classes" not in mined.columns:
        mined = mined.withColumn("classes", F.transform("tokens", lambda t: F.array(t)))
    filed = _filed(mined).select(F.col("filed").alias("item"), F.col("tokens").alias("need"), "confidence")
    stands = mined.select(F.explode(F.arrays_zip("tokens", "classes")).alias("x")).select(F.col("x.tokens").alias("item"), F.explode("x.classes").alias("token")).distinct()
    if mined.count() <= FEW_RULES:
        filed = F.broadcast(filed)
    wide = read.withColumn("__tokens", tokens_of(F.col("host"), F.col("path"), F.col("__url")))
    # Urls repeat; each distinct token list is matched once, by the items that its tokens stand for.
    lists = wide.where(F.col("rule").isNull()).select("__tokens").distinct()
    items = lists.select("__tokens", F.explode("__tokens").alias("token")).join(stands, "token").groupBy("__tokens").agg(F.collect_set("item").alias("has"))
    fired = items.select("__tokens", "has", F.explode("has").alias("item")).join(filed, "item").where(F.size(F.array_except("need", "has")) == 0)
    best = fired.groupBy("__tokens").agg(F.max(F.struct(F.col("confidence").alias("c"), F.array_join("need", " & ").alias("r")))["r"].alias("__mined"))
    # Written first: the join with all urls is then between plain exchanges, and may split a token list that very many urls have.
    best = materialize(best, "op7-best")
    out = wide.join(best, "__tokens", "left").withColumn("mined_rule", F.when(F.col("rule").isNull(), F.col("__mined")))
    return out.select(*back, "host", "path", "rule", F.coalesce("__verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule")
