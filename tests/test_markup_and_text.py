from collections import Counter

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.config import PipelineConfig
from weftline.functions import markup, text, wikitext
from weftline.operators import links as L


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a <ref name=\"q\"/> b <ref>c<ref>d</ref>e</ref> f", "a  b  f"),
        ("x<!-- y --->z<!-- a\nb -->c", "xzc"),
        ("{{a {{b {{c}} }} d}}e{{nowrap|f g}}h", "ef gh"),
        ("a&nbsp;b&#8209;c", "a b-c"),
        ("a\n b c\n d\ne", "a\ne"),
        ("<references/>a<math>x<math>y</math></math>b<pre>c</pre>", "ab"),
        ("<gallery>" * 12 + "x" + "</gallery>" * 12 + "y", "y"),
        ("{{" * 9 + "x" + "}}" * 9 + "y{{z", "y{{z"),
        ("", ""),
        (None, None),
    ],
)
def test_cleaning(spark, given, wanted):
    assert one(spark, markup.clean_markup, given) == wanted


def test_sentences_have_true_spans(spark):
    given = "Mr. Smith came. \"Did he?\"  Yes, at 5 p.m. on J. Doe's day! 7 left.\tThe end"
    found = one(spark, text.sentences, given)
    assert [x["text"] for x in found] == ["Mr. Smith came.", "\"Did he?\"", "Yes, at 5 p.m. on J. Doe's day!", "7 left.", "The end"]
    assert all(given[x["begin"] : x["end"]] == x["text"] for x in found)
    assert one(spark, text.sentences, "  ") == [] and one(spark, text.sentences, None) is None


def test_words_are_found_between_letters(spark):
    given = "cat concat cat, cats cat"
    assert one(spark, lambda x: text.find_word(x, "cat"), given) == [0, 11, 21]
    for given, word, found in (("aa a", "a", [3]), ("thethe the", "the", [7]), ("the", "the", [0]), ("x.y xzy x.y", "x.y", [0, 8]), ("ana anana ana-ana", "ana", [0, 10, 14]), ("a\\Eb b", "a\\Eb", [0]), ("\u00e9cat cat\u00e9 cat", "cat", [10]), ("", "a", [])):
        assert one(spark, lambda x, w=word: text.find_word(x, w), given) == found
    assert one(spark, lambda x: text.find_word(x, "a"), None) is None


def test_many_sentences_take_no_square_of_time(spark):
    whole = " ".join(f"This is sentence {k}." for k in range(16_000))
    begun = time.monotonic()
    found = one(spark, text.sentences, whole)
    assert [whole[x["begin"] : x["end"]] for x in (found[0], found[7777], found[-1])] == ["This is sentence 0.", "This is sentence 7777.", "This is sentence 15999."]
    assert len(found) == 16_000 and time.monotonic() - begun < 10


def test_tokens(spark):
    found = one(spark, text.tokens, "The boxes of Alice's friends moved, quickly.")
    assert [(x["text"], x["pos"], x["lemma"]) for x in found] == [("The", "DT", "the"), ("boxes", "NNS", "box"), ("of", "IN", "of"), ("Alice's", "NNP", "Alice's"), ("friends", "NNS", "friend"), ("moved", "NN", "moved"), (",", ".", ","), ("quickly", "RB", "quickly"), (".", ".", ".")]
    assert one(spark, text.tokens, None) == []


def test_wikitext():
    out = wikitext.parse("== Head ==\n'''Cars''' and [[motor bike|bikes]], [[File:x.jpg|thumb|A]] [http://a.b c d].\nMore [[text]].\n\n* item [[one]]\n{| class=x\n| y\n|}\n<br/>[[:Category:Z|z]]")
    assert [p["text"] for p in out] == ["Cars and bikes,  c d. More text.", "item one", "z"]
    assert [(x["target"], p["text"][x["begin"] : x["end"]]) for p in out for x in p["links"]] == [("motor bike", "bikes"), ("text", "text"), ("one", "one"), ("Category:Z", "z")]


def test_page_links_explicit_and_implicit(spark):
    page = "Big [[car|cars]] go. Old cars stop and [[rail road]]\n\nCars are fast. The cars and rail roads; see [[car|cars]]."
    s = L.page_sentences(spark.createDataFrame([("P", page)], "title string, text string")).persist()
    rows = s.orderBy("sent").collect()
    # The last link of the first paragraph ends where its sentence ends and is not taken.
    assert [(r["sent"], r["text"], [(x["target"], x["begin"], x["end"]) for x in r["links"]]) for r in rows] == [
        (0, "Big cars go.", [("Car", 4, 8)]), (1, "Old cars stop and rail road", []), (2, "Cars are fast.", []), (3, "The cars and rail roads; see cars.", [("Car", 29, 33)]),
    ]
    more = L.implicit_links(s)
    assert sorted(tuple(r) for r in more.select("sent", "target", "begin", "end").collect()) == [(1, "Car", 4, 8), (3, "Car", 4, 8)]
    union = {r["sent"]: len(r["links"]) for r in L.all_links(s).collect()}
    assert union == {0: 1, 1: 1, 3: 2}
    few = PipelineConfig(max_links=1, max_implicit_links=2, max_sentence_length=14)
    assert L.explicit_links(s, few).count() == 0 and {r["sent"] for r in L.all_links(s, few).collect()} == {0, 1}
    assert L.page_sentences(spark.createDataFrame([("P", page)], "title string, text string"), few).count() == 2
    assert L.page_sentences(spark.createDataFrame([("P", page)], "title string, text string"), PipelineConfig(max_page_length=10)).count() == 0


def test_lemma_counts_are_those_of_tokens(spark):
    texts = ["Boxes of boxes moved, quickly.", "The boxes are Alice's Boxes; ponies", "", None, "- ponies 3 ponies Ponies", "Alice saw Alice"] * 3
    wanted = Counter(t["lemma"] for x in texts for t in text.tokenize(x) if t["pos"] in ("NN", "NNS"))
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for most in (2, 200_000):
        assert {r["lemma"]: r["cnt"] for r in text.lemma_counts(df, ("NN", "NNS"), most).collect()} == wanted


def test_paragraphs_are_packed_piece_by_piece():
    pages = ["a [[b|c]] d\n\ne", None, "", "x" * 50, "* i\n* j [[k]]"] * 4
    kind = to_arrow_type(T._parse_datatype_string(wikitext.PARAGRAPHS))
    pieces = list(wikitext._parsed(pa.array(pages), kind, 40))
    assert len(pieces) > 4 and max(len(x) for x in pieces) < 8
    assert pa.concat_arrays(pieces).to_pylist() == [wikitext.parse(x) for x in pages]
