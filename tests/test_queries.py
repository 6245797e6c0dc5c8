"""Every query with SQL for it gives the same rows in DuckDB, and none of the others is empty."""

import collections
import html
import math
import os
import re

import duckdb
import pytest
import regex

from weftline.functions import text as F
from weftline.plans import bindings as B
from weftline.plans import text_queries as T
from weftline.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    made = duck.sql(ORACLE_SQL[name])
    assert sorted(made.columns) == columns
    place = [made.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in place) for r in made.fetchall()), key=repr)


def test_token_queries_take_long_sentences(spark):
    rows = {f"{r['doc_id']}:{r['sent']}": r["text"] for r in B.sentences(spark, DIR).collect()}
    wanted = {}
    for sid, text in rows.items():
        words = text.split(" ")
        if len(words) > 2 and not words[1].endswith("ed"):
            wanted[sid] = (words[1].lower(), len(words[0]) + 1, len(words[0]) + 1 + len(words[1]))
    assert any(len(rows[sid]) > 200 for sid in wanted)
    found = QUERIES["token_span_join_whole"](spark, DIR).collect()
    assert len(found) == len(wanted) and {r["sid"]: (r["lemma"], r["begin"], r["end"]) for r in found} == wanted
    covered = {r["sid"]: r["links"] for r in QUERIES["covered_tokens_whole"](spark, DIR).collect()}
    assert covered == {sid: f"{w}@@1@{b}:{e}" for sid, (w, b, e) in wanted.items() if w}


def find_all(text, word):
    """Spans of word in text that no letter touches; the search goes on behind each occurrence, also one that a letter touches."""
    found = [(m.start(), m.end()) for m in re.finditer(re.escape(word), text)]
    return [(b, e) for b, e in found if not text[b - 1 : b].isalpha() and not text[e : e + 1].isalpha()]


def test_implicit_minus_explicit_links(spark):
    rows = T._discourse(spark, DIR).collect()
    texts, explicit = {}, set()
    for r in rows:
        for x in r["links"]:
            texts.setdefault(r["title"], set()).add((r["text"][x["begin"] : x["end"]], x["target"]))
            explicit.add((r["title"], r["sent"], x["target"], x["begin"], x["end"]))
    found = {(r["title"], r["sent"], target, b, e) for r in rows for word, target in texts.get(r["title"], ()) for b, e in find_all(r["text"], word)}
    made = [tuple(r) for r in QUERIES["implicit_minus_explicit_links"](spark, DIR).collect()]
    assert found & explicit and len(made) == len(set(made)) and set(made) == found - explicit
    assert sorted(made) == sorted(tuple(r) for r in QUERIES["implicit_links"](spark, DIR).collect())


def test_surface_text_filter_keeps_and_drops_links(spark):
    links = [r["links"] for r in QUERIES["surface_text_filter"](spark, DIR).collect()]
    assert 0 < len(links) < B.sentences(spark, DIR).count()
    assert any("  " in x for x in links) and any("  " not in x for x in links)


def test_document_text_rebase_goes_through_the_codec(spark, monkeypatch):
    called = []
    for name in ("document_links", "document_text"):
        monkeypatch.setattr(T.codec, name, lambda c, f=getattr(T.codec, name), name=name: called.append(name) or f(c))
    spans, texts = QUERIES["document_text_rebase"](spark, DIR).collect(), {r["doc_id"]: r["text"] for r in QUERIES["document_text_lines"](spark, DIR).collect()}
    assert called == ["document_links", "document_text"]
    lines = {r["doc_id"]: r["text"].replace("\t", " ").split("\n") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r["text"]}
    assert len(spans) == sum(1 for x in lines.values() for y in x if y)
    assert all(texts[r["doc_id"]][r["begin"] : r["end"] + 1] == lines[r["doc_id"]][r["pos"]] + "\n" for r in spans)


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r["text"]}


SPACE = " \t\n\x0b\f\r"


def test_noun_counts(spark):
    wanted = collections.Counter()
    for text in documents(spark).values():
        for sentence in re.split(r"(?<=[.!?])\s+", text.replace("\n", " "), flags=re.A):
            wanted.update(t["lemma"] for t in F.tokenize(sentence.strip(SPACE)) if t["pos"] in ("NN", "NNS"))
    assert len(wanted) > 1000 and {r["lemma"]: r["cnt"] for r in QUERIES["noun_counts"](spark, DIR).collect()} == wanted


def test_wikitext_paragraphs(spark):
    wanted = set()
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        page = re.sub(r"\n .*", "", re.sub(r"<!--.*?-{2,3}>", "", r["html"], flags=re.S).replace("&nbsp;", " ").replace("&#8209;", "-"))
        assert not any(x in page for x in ("{{", "{|", "[[", "://", "''", "<ref", "<pre", "<math", "<source"))
        paragraphs, open_ = [], False
        for line in re.sub(r"</?[a-zA-Z][^<>]*>", "", page).split("\n"):
            item = line[:1] in ("*", "#", ":", ";")
            if not line.strip() or re.fullmatch(r"\s*(={2,6}.*={2,6}|-{4,}|__[A-Z]+__)\s*", line):
                open_ = False
            elif open_ and not item:
                paragraphs[-1] += " " + line
            else:
                paragraphs.append(line.lstrip("*#:; ") if item else line)
                open_ = not item
        texts = [x for x in map(html.unescape, paragraphs) if x.strip()]
        wanted |= {(r["page_id"], k, len(x)) for k, x in enumerate(texts)}
    assert wanted and {(r["page_id"], r["para"], r["n"]) for r in QUERIES["wikitext_paragraphs"](spark, DIR).collect()} == wanted


def ends_sentence(text, m):
    """Whether the white space m of text is a boundary: end mark, no abbreviation, a likely beginning behind it."""
    before, after = text[: m.start()], text[m.end() :]
    mark = regex.search(r"[.!?][\"'”’)\]]{0,2}$", before)
    short = regex.search(r"(?<!\w)(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|No|Inc|Ltd|Co|cf|approx|[A-Z])\.$", before)
    return bool(mark and not short and regex.match(r"[\"'“‘(\[]{0,2}[\p{Lu}\p{N}]", after))


def test_wikitext_links(spark):
    """Each line whose second token is a word begins a paragraph, with a link over this word."""
    wanted = set()
    for doc, text in documents(spark).items():
        assert html.unescape(text) == text and not re.search(r"\[\[|\{\{|\{\||<[a-zA-Z/!]|''|://|^[ *#:;=_-]", text, flags=re.M)
        paragraphs, open_ = [], False
        for line in text.split("\n"):
            m = regex.match(r"([^ \t\n\x0b\f\r]+) (\p{L}+) ", line)
            if not line.strip():
                open_ = False
            elif open_ and not m:
                paragraphs[-1][0] += " " + line
            else:
                paragraphs.append([line, m and (m[2], m.start(2), m.end(2))])
                open_ = True
        sent = 0
        for whole, link in paragraphs:
            cuts = [m.end() for m in re.finditer(r"\s+", whole, flags=re.A) if ends_sentence(whole, m)]
            for a, b in zip([0, *cuts], [*cuts, len(whole)]):
                body = whole[a:b].strip(SPACE)
                if not body:
                    continue
                a += len(whole[a:b]) - len(whole[a:b].lstrip(SPACE))
                inside = link and a <= link[1] and link[2] < a + len(body)
                if len(body) <= 1000:
                    wanted.add((f"Doc {doc}", sent, body, f"Target_of_{link[0]}@{link[1] - a}:{link[2] - a}" if inside else ""))
                sent += 1
    made = [tuple(r[c] for c in ("title", "sent", "text", "links")) for r in QUERIES["wikitext_links"](spark, DIR).collect()]
    assert sum(1 for x in wanted if x[3]) > 100 and len(made) == len(set(made)) and set(made) == wanted


def exchanges(df):
    """What rows are dealt by, in the plan before it runs."""
    return re.findall(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString())


def test_covered_tokens_are_dealt_by_sentence_alone(spark):
    """Dealt by target, all sentences of one target would meet in one task."""
    found = exchanges(QUERIES["covered_tokens_whole"](spark, DIR))
    assert len(found) == 1 and found[0].startswith("hashpartitioning(sid#")


def test_contexts_are_dealt_by_instance_alone(spark):
    """Dealt by word and feature, a few very frequent pairs would make the partitions."""
    found = exchanges(QUERIES["wsd_choose_cluster"](spark, DIR))
    assert any("l_orderkey#" in x for x in found) and not any("feature#" in x and "word#" in x and "cluster_id" not in x and "_groupingexpression" not in x for x in found)


def test_evaluation_finds_the_links_once(spark):
    """Counts and predictions use the instances several times; they are read from kept counts, not from the documents."""
    assert not any("documents.parquet" in x for x in QUERIES["cluster_evaluation_flow"](spark, DIR).inputFiles())


def test_implicit_links_read_documents_once(spark):
    for name in ("implicit_links", "implicit_minus_explicit_links"):
        assert QUERIES[name](spark, DIR)._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
