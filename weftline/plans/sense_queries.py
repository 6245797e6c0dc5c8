"""Queries on dependencies, triples, and the evaluation of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import dependencies as P
from weftline.operators import evaluate as E
from weftline.plans import bindings as B
from weftline.plans import scratch
from weftline.plans.registry import query

# A small tree for each nation: "The <name> of <region> sells red parts to buyers".
_T = [("The", "DT"), ("{n}", "NN"), ("of", "IN"), ("{r}", "NNS"), ("sells", "VB"), ("red", "JJ"), ("parts", "NNS"), ("according", "VB"), ("to", "IN"), ("buyers", "NNS")]
_D = [(1, 0, "det"), (1, 2, "prep"), (2, 3, "pobj"), (4, 1, "nsubj"), (6, 5, "amod"), (4, 6, "dobj"), (4, 8, "prep"), (8, 7, "mwe"), (8, 9, "pobj")]


def _trees(spark, sf):
    nation, region = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("n"), F.lower("r_name").alias("r"))
    word = lambda w: {"{n}": F.col("n"), "{r}": F.col("r")}.get(w, F.lit(w))
    token = lambda w, tag: F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), word(w).alias("text"), F.lit(tag).alias("pos"), F.lower(word(w)).alias("lemma"))
    edge = lambda g, d, t: F.struct(F.lit(g).alias("gov"), F.lit(d).alias("dep"), F.lit(t).alias("type"), F.lit(0).alias("begin"), F.lit(0).alias("end"))
    return rows.select("n_nationkey", F.array(*(token(*t) for t in _T)).alias("tokens"), F.array(*(edge(*d) for d in _D)).alias("deps"))


_WORDS = ", ".join(f"({k}, '{w}', '{tag}')" for k, (w, tag) in enumerate(_T))
_EDGES = ", ".join(f"({g}, {d}, '{t}')" for g, d, t in _D)
_TREES = f"""WITH words(i, w, tag) AS (VALUES {_WORDS}), edges(gov, dep, type) AS (VALUES {_EDGES}),
tokens AS (SELECT n_nationkey, i, lower(replace(replace(w, '{{n}}', n_name), '{{r}}', r_name)) AS lemma, tag FROM nation JOIN region ON n_regionkey = r_regionkey, words),
named AS (SELECT g.n_nationkey, gov, dep, type, g.lemma AS gl, d.lemma AS dl FROM edges JOIN tokens g ON g.i = gov JOIN tokens d ON d.i = dep AND d.n_nationkey = g.n_nationkey)"""


@query(_TREES + " SELECT n_nationkey, i AS word, f AS bim FROM (SELECT n_nationkey, gov AS i, type || '(@@,' || dl || ')' AS f FROM named UNION ALL SELECT n_nationkey, dep, type || '(' || gl || ',@@)' FROM named)")
def bim_features(spark, sf):
    each = _trees(spark, sf).withColumn("word", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)))
    return each.select("n_nationkey", "word", F.explode(P.bims(F.col("deps"), F.col("tokens"), F.col("word"))).alias("bim"))


@query(_TREES + " SELECT n_nationkey, gl AS key, dl AS value, type AS relation, 0 AS hole FROM named UNION ALL SELECT n_nationkey, dl, gl, type, 1 FROM named")
def holing(spark, sf):
    x = _trees(spark, sf).select("n_nationkey", F.explode(P.holing(F.col("deps"), F.col("tokens"))).alias("f"))
    return x.select("n_nationkey", "f.key", F.col("f.values")[0].alias("value"), "f.relation", "f.hole")


@query(_TREES + """, prep AS (SELECT p.n_nationkey, p.gov, o.dep, p.dep AS i, 'prep_' || coalesce(m.dl || '_', '') || p.dl AS type FROM named p JOIN tokens t ON t.i = p.dep AND t.n_nationkey = p.n_nationkey AND t.tag = 'IN' JOIN named o ON o.gov = p.dep AND o.type = 'pobj' AND o.n_nationkey = p.n_nationkey LEFT JOIN named m ON m.gov = p.dep AND m.type = 'mwe' AND m.n_nationkey = p.n_nationkey WHERE p.type = 'prep')
SELECT n_nationkey, gov, dep, type FROM prep UNION ALL SELECT n_nationkey, gov, dep, type FROM named n WHERE NOT EXISTS (SELECT 1 FROM prep p WHERE p.n_nationkey = n.n_nationkey AND ((n.type = 'prep' AND n.dep = p.i) OR (n.type IN ('pobj', 'mwe') AND n.gov = p.i)))""")
def collapse_prepositions(spark, sf):
    x = _trees(spark, sf).select("n_nationkey", F.explode(P.collapse_prepositions(F.col("deps"), F.col("tokens"))).alias("e"))
    return x.select("n_nationkey", "e.gov", "e.dep", "e.type")


#: Subject and object of a verb, modifiers as predicates.
PATTERNS = """
? ? ?\t*#n* det *
z y ?\t* subj *
? y z\t* dobj|prep_to *
y * z\t*#n* prep_of *
"""


# A verb's triple is noted after its object and after each child behind that; collapsed prepositions come last.
@query(_TREES + """, verbs AS (SELECT n_nationkey, gov, s.dl AS subject, s.gl AS predicate, o.dl AS object FROM named s JOIN named o USING (n_nationkey, gov) WHERE s.type = 'nsubj' AND o.type = 'dobj')
SELECT n_nationkey, subject, predicate, object FROM verbs UNION ALL SELECT n_nationkey, subject, predicate, object FROM verbs JOIN named p USING (n_nationkey, gov) WHERE p.type = 'prep'
UNION ALL SELECT p.n_nationkey, p.gl, CAST(NULL AS VARCHAR), o.dl FROM named p JOIN named o ON o.n_nationkey = p.n_nationkey AND o.gov = p.dep JOIN tokens t ON t.n_nationkey = p.n_nationkey AND t.i = p.gov WHERE p.type = 'prep' AND p.dl = 'of' AND o.type = 'pobj' AND starts_with(t.tag, 'N')""")
def dependency_triples(spark, sf):
    collapsed = _trees(spark, sf).withColumn("deps", P.collapse_prepositions(F.col("deps"), F.col("tokens")))
    x = collapsed.select("n_nationkey", F.explode(P.triples(F.col("tokens"), F.col("deps"), P.parse_patterns(PATTERNS))).alias("t"))
    return x.select("n_nationkey", "t.subject", "t.predicate", "t.object")


def _instances(spark, sf):
    """(fold, word, cluster_id, gold): lines of parts; the supplier's last digit is the cluster, sometimes missing."""
    line, part = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") % 5).alias("fold"), F.col("p_name").alias("word"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 10).alias("cluster_id"), F.col("p_brand").alias("gold"))


_INSTANCES = "instances AS (SELECT l_orderkey % 5 AS fold, p_name AS word, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 10 END AS cluster_id, p_brand AS gold FROM lineitem JOIN part ON l_partkey = p_partkey)"
_FOLDS = f"""WITH {_INSTANCES}, folds AS (SELECT DISTINCT fold FROM instances),
wc AS (SELECT f.fold, word, gold, count(*) AS cnt FROM folds f JOIN instances i ON i.fold <> f.fold GROUP BY ALL),
base AS (SELECT fold, word, arg_min(gold, (-cnt, gold)) AS baseline FROM wc GROUP BY ALL),
cc AS (SELECT f.fold, word, cluster_id, gold, count(*) AS cnt FROM folds f JOIN instances i ON i.fold <> f.fold WHERE cluster_id IS NOT NULL GROUP BY ALL),
clus AS (SELECT fold, word, cluster_id, arg_min(gold, (-cnt, gold)) AS cluster_sense FROM cc GROUP BY ALL),
predicted AS (SELECT i.*, baseline, cluster_sense, coalesce(cluster_sense, baseline) AS sense FROM instances i LEFT JOIN base USING (fold, word) LEFT JOIN clus ON clus.fold = i.fold AND clus.word = i.word AND clus.cluster_id = i.cluster_id)"""


@query(f"WITH {_INSTANCES}, c AS (SELECT word, cluster_id, gold, count(*) AS cnt FROM instances WHERE cluster_id IS NOT NULL GROUP BY ALL) SELECT word, cluster_id, string_agg(gold || ':' || cnt, '  ' ORDER BY cnt DESC, gold) AS senses FROM c GROUP BY ALL")
def cluster_mapping(spark, sf):
    counts = E.confusion(_instances(spark, sf).where(F.col("cluster_id").isNotNull()), ["word", "cluster_id"])
    return E.mapping(counts, ["word", "cluster_id"])


@query(f"WITH {_INSTANCES}, c AS (SELECT word, gold, count(*) AS cnt FROM instances GROUP BY ALL) SELECT word, arg_min(gold, (-cnt, gold)) AS sense FROM c GROUP BY word")
def mfs_mapping(spark, sf):
    return E.most_frequent(E.confusion(_instances(spark, sf), ["word"]), ["word"])


_METRICS = """CAST(count(*) AS BIGINT) AS instances, CAST(count(baseline) AS BIGINT) AS with_baseline, CAST(count(cluster_id) AS BIGINT) AS with_cluster, CAST(count(cluster_sense) AS BIGINT) AS with_cluster_sense,
CAST(count(*) FILTER (WHERE cluster_id IS NOT NULL AND cluster_sense IS NULL) AS BIGINT) AS cluster_without_sense, CAST(count(*) FILTER (WHERE baseline = gold) AS BIGINT) AS correct_baseline, CAST(count(*) FILTER (WHERE cluster_sense = gold) AS BIGINT) AS correct_cluster,
CAST(count(*) FILTER (WHERE sense = gold) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE sense <> gold) AS BIGINT) AS incorrect, CAST(count(*) FILTER (WHERE sense IS NULL) AS BIGINT) AS unanswered, CAST(count(*) FILTER (WHERE cluster_sense IS NULL AND sense = gold) AS BIGINT) AS correct_by_fallback"""


@query(_FOLDS + f" SELECT {_METRICS} FROM predicted")
def cluster_eval_metrics(spark, sf):
    return E.metrics(E.predictions(_instances(spark, sf)))


@query(_FOLDS + " SELECT fold, word, baseline, CAST(count(*) AS BIGINT) AS instances, CAST(count(*) FILTER (WHERE baseline = gold) AS BIGINT) AS correct FROM predicted GROUP BY ALL")
def leave_one_out(spark, sf):
    return E.predictions(_instances(spark, sf)).groupBy("fold", "word", "baseline").agg(F.count("*").alias("instances"), F.count_if(F.col("baseline") == F.col("gold")).alias("correct"))


@query("""WITH contexts AS (SELECT DISTINCT o_orderkey AS iid, o_orderpriority AS word, l_returnflag || l_linestatus || l_linenumber AS feature FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
clusters AS (SELECT o_orderpriority AS word, o_custkey % 4 AS cluster_id, l_returnflag || l_linestatus || l_linenumber AS feature, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 3 = 0 GROUP BY ALL),
shared AS (SELECT iid, cluster_id, sum(weight) AS score FROM contexts JOIN clusters USING (word, feature) GROUP BY ALL)
SELECT iid, arg_min(cluster_id, (-score, cluster_id)) AS cluster_id, CAST(max(score) AS BIGINT) AS score FROM shared GROUP BY iid""")
def wsd_choose_cluster(spark, sf):
    lines = E.dealt(B.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"), "l_orderkey")
    both = lines.join(B.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = both.select(F.col("l_orderkey").alias("iid"), F.col("o_orderpriority").alias("word"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("feature"), "o_custkey")
    clusters = rows.where("o_custkey % 3 = 0").groupBy("word", (F.col("o_custkey") % 4).alias("cluster_id"), "feature").agg(F.count("*").alias("weight"))
    return E.choose_cluster(rows.select("iid", "word", "feature"), F.broadcast(clusters))  # by 5 priorities, 4 remainders and the kinds of lines


@query("WITH edges AS (SELECT p_partkey, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey) SELECT l_suppkey AS cluster_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_partkey) AS BIGINT) AS d FROM edges GROUP BY l_suppkey")
def cluster_sizes(spark, sf):
    rows = B.table(spark, sf, "part").join(B.table(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("cluster_id")).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("d"))


_FLOW = f"""WITH {B.SENTENCES}, items AS (SELECT row_number() OVER () AS r, list_distinct(string_split(lower(text), ' ')) AS ws FROM benchmark),
words AS (SELECT DISTINCT unnest(ws) AS word FROM items), clusters AS (SELECT word, length(feature) % 3 AS cluster_id, feature, CAST(count(*) AS BIGINT) AS weight FROM (SELECT word, unnest(ws) AS feature FROM (SELECT unnest(ws) AS word, ws FROM items)) GROUP BY ALL),
tokens AS (SELECT doc_id, sent, list_transform(string_split(text, ' '), lambda x: lower(x)) AS ws FROM sentences),
linked AS (SELECT doc_id || ':' || sent || '#0' AS iid, doc_id % 5 AS fold, ws[2] AS word, 'S' || length(ws[1]) % 5 AS gold, list_filter(list_distinct(ws), lambda x: x <> ws[2]) AS context FROM tokens WHERE len(ws) > 1),
kept AS (SELECT * FROM linked WHERE word IN (SELECT word FROM words) AND gold <> 'S4'),
shared AS (SELECT iid, cluster_id, sum(weight) AS score FROM (SELECT iid, word, unnest(context) AS feature FROM kept) JOIN clusters USING (word, feature) GROUP BY ALL),
chosen AS (SELECT iid, arg_min(cluster_id, (-score, cluster_id)) AS cluster_id FROM shared GROUP BY iid),
instances AS (SELECT iid, fold, word, cluster_id, gold FROM kept LEFT JOIN chosen USING (iid))"""


def _flow(spark, sf):
    """Sentences of documents in five folds, a link over the second word and one over the first two; senses, words and clusters."""
    from weftline.plans.text_queries import _all_tokens

    t = lambda k: F.get("tokens", F.lit(k - 1))
    gold = F.concat(F.lit("S"), (F.length(t(1)["text"]) % 5).cast("string"), F.lit("#part"))
    link = lambda b, e: F.struct(F.lit(None).cast("string").alias("lemma"), gold.alias("target"), b.alias("begin"), e.alias("end"))
    rows = _all_tokens(spark, sf).where(F.instr("sentence", " ") > 0).select((F.col("doc_id") % 5).alias("fold"), "sid", "tokens", F.array(link(t(2)["begin"], t(2)["end"]), link(t(1)["begin"], t(2)["end"])).alias("links"))
    senses = spark.range(4).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("resource"))
    items = B.table(spark, sf, "benchmark").select(F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    both = items.select("ws", F.explode("ws").alias("word")).select("word", F.explode("ws").alias("feature"))
    clusters = both.groupBy("word", (F.length("feature") % 3).alias("cluster_id"), "feature").agg(F.count("*").alias("weight"))
    return rows, F.broadcast(senses), items.select(F.explode("ws").alias("word")).distinct(), clusters


@query(_FLOW + " SELECT iid, fold, word, gold, CAST(len(context) AS INTEGER) AS n_context FROM kept")
def evaluation_instances(spark, sf):
    """Links with a sense and a head word that are asked for, and how many lemmas stand around."""
    rows, senses, words, _ = _flow(spark, sf)
    return E.link_instances(rows, senses, words).select("iid", "fold", "word", "gold", F.size("context").alias("n_context"))


@query(_FLOW + ", folds AS" + _FOLDS.split("folds AS", 1)[1] + f" SELECT {_METRICS} FROM predicted")
def cluster_evaluation_flow(spark, sf):
    """From tokenised sentences with links to the figures of the evaluation."""

    def keep(rows):
        path = scratch.folder(spark, "evaluation")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return E.metrics(E.evaluate(*_flow(spark, sf), keep))
