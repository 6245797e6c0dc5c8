"""Sentences and tokens with character spans.

No trained model is at hand offline, so both are rule-based; any function with the same result
type can take their place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrays import let, starts_of
from weftline.schema import TOKEN

#: A boundary is white space after an end mark, unless an abbreviation or initial stands before it, with a likely beginning behind it.
BOUNDARY = r"(?<=[.!?][\"'”’)\]]{0,2})(?<!\b(?:Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|No|Inc|Ltd|Co|cf|approx|[A-Z])\.)(\s+)(?=[\"'“‘(\[]{0,2}[\p{Lu}\p{N}])"
PLAIN_BOUNDARY = r"(?<=[.!?])(\s+)"
_MARK = "\x01"
#: What \s stands for in the JVM, but for the blank.
_SPACES = "\t\n\x0b\f\r"


def one_line(text: Column) -> Column:
    """Line breaks to blanks; lengths, and so spans, stay."""
    return F.translate(text, "\n", " ")


def sentences(text: Column, boundary: str = BOUNDARY) -> Column:
    """array<struct<begin, end, text>>: sentences without the white space between them; spans count characters."""
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), boundary, "$1" + _MARK), _MARK)

    def item(piece: Column, at: Column) -> Column:
        def placed(plain: Column) -> Column:
            lead, body = F.length(piece) - F.length(F.ltrim(plain)), F.length(F.trim(plain))
            begin = at + lead
            return F.struct(begin.cast("int").alias("begin"), (begin + body).cast("int").alias("end"), F.substr(piece, lead + 1, body).alias("text"))

        return let(F.translate(piece, _SPACES, " " * len(_SPACES)), placed)

    def whole(parts: Column) -> Column:
        return let(starts_of(F.transform(parts, F.length)), lambda at: F.filter(F.transform(parts, lambda piece, k: item(piece, F.get(at, k))), lambda s: s["begin"] < s["end"]))

    return let(pieces, whole)


_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
# Closed word classes of the rule-based tagger.
_CLOSED = {
    "DT": "a an the this that these those each every some any no".split(),
    "IN": "of in on at by for with from into about over under after before between through during against than as".split(),
    "CC": "and or but nor".split(),
    "PRP": "i you he she it we they me him her us them".split(),
    "PRP$": "my your his its our their".split(),
    "MD": "can could may might must shall should will would".split(),
    "TO": ["to"],
    "WDT": "which who whom whose what when where why how".split(),
    "VB": "be am is are was were been being have has had do does did".split(),
}
_TAG = {w: tag for tag, words in _CLOSED.items() for w in words}
_BASE = {"am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "does": "do", "did": "do"}


def lemma_of(word: str, tag: str) -> str:
    """The base form by suffix rules; lower case but for proper nouns."""
    low = word.lower()
    if low in _BASE:
        return _BASE[low]
    if tag == "NNP":
        return word
    if tag == "NNS":
        for suffix, base in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("s", "")):
            if low.endswith(suffix):
                return low[: -len(suffix)] + base
    return low


def tag_of(word: str, first: bool) -> str:
    low = word.lower()
    if low in _TAG:
        return _TAG[low]
    if not any(c.isalnum() for c in word):
        return "."
    if word[0].isdigit():
        return "CD"
    if word[0].isupper() and not first:
        return "NNP"
    if low.endswith("ly"):
        return "RB"
    if low.endswith(("ing", "ed", "ize", "ise")) and len(low) > 5:
        return "VB"
    if low.endswith(("ous", "ful", "ive", "able", "al", "ic")) and len(low) > 4:
        return "JJ"
    return "NNS" if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else "NN"


def tokenize(sentence: str | None) -> list[dict]:
    out = []
    for k, m in enumerate(_TOKEN.finditer(sentence or "")):
        tag = tag_of(m[0], k == 0)
        out.append({"begin": m.start(), "end": m.end(), "text": m[0], "pos": tag, "lemma": lemma_of(m[0], tag)})
    return out


def tokens(sentence: Column, tokenizer: Callable[[str | None], list[dict]] = tokenize) -> Column:
    """array<struct<begin, end, text, pos, lemma>> by any tokenizer that returns such dicts; Arrow batches, not rows."""

    @F.pandas_udf(T._parse_datatype_string(f"array<{TOKEN}>"))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tokenizer)

    return run(sentence)


def lemma_counts(sentences: DataFrame, pos: tuple[str, ...], most: int = 200_000) -> DataFrame:
    """(lemma, cnt) of all tokens of these parts of speech, as tokenize tells them, in sentences (text).

    A token's tag and lemma depend on nothing but its word and whether it comes first, so workers
    count words, up to `most` different ones at a time, and tag and lemmatise each of them once.
    """

    def lemmas(counted: list[tuple[Counter, bool]]) -> pa.RecordBatch:
        out = Counter()
        for words, first in counted:
            for word, n in words.items():
                tag = tag_of(word, first)
                if tag in pos:
                    out[lemma_of(word, tag)] += n
            words.clear()
        return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["lemma", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, later = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                words = _TOKEN.findall(text.as_py() or "")
                if words:
                    first[words[0]] += 1
                    del words[0]
                    later.update(words)
                if len(first) + len(later) > most:
                    yield lemmas([(first, True), (later, False)])
        yield lemmas([(first, True), (later, False)])

    return sentences.select("text").mapInArrow(run, "lemma string, cnt bigint").groupBy("lemma").agg(F.sum("cnt").alias("cnt"))


def find_word(text: Column, word: str | Column) -> Column:
    """Begins (from 0) of all occurrences of a word that no letter touches.

    The text is searched from the left; the search goes on behind each occurrence, one that a letter
    touches included, so occurrences never overlap.
    """
    w = F.lit(word) if isinstance(word, str) else word
    pattern = F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letter = lambda c: c.rlike(r"^\p{L}")

    def found(parts: Column) -> Column:
        last = F.size(parts) - 1

        def hit(piece: Column, k: Column, at: Column) -> Column:
            behind = F.get(parts, k + 1)
            before = F.when((F.length(piece) == 0) & (k > 0), w).otherwise(piece)
            after = F.when((F.length(behind) == 0) & (k + 1 < last), w).otherwise(behind)
            free = ~letter(F.right(before, F.lit(1))) & ~letter(F.left(after, F.lit(1)))
            return F.when((k < last) & free, (F.get(at, k) + F.length(piece)).cast("int"))

        lengths = F.transform(parts, lambda x: F.length(x) + F.length(w))
        return let(starts_of(lengths), lambda at: F.filter(F.transform(parts, lambda x, k: hit(x, k, at)), lambda b: b.isNotNull()))

    return let(F.split(text, pattern, -1), found)
