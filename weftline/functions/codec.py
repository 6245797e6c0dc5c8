r"""Text form of links: elements `lemma@@target@begin:end` joined by two blanks; the lemma may be missing.

Inside the engine links are arrays of structs; this form is for text files alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.arrays import let, starts_of

SEPARATOR, LEMMA_END = "  ", "@@"
_ELEMENT = r"(?s)^(?:(.*?)@@)?(.*)@([0-9]+):([0-9]+)$"


def whole(number: Column) -> Column:
    """An int written as optional sign and digits; null for anything else, blanks and overflow included."""
    return F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("int"))


def decode_link(element: Column) -> Column:
    """One element as a struct; null if it has not this form."""
    lemma = F.when(F.instr(element, LEMMA_END) > 0, F.regexp_extract(element, _ELEMENT, 1))
    begin, end = whole(F.regexp_extract(element, _ELEMENT, 3)), whole(F.regexp_extract(element, _ELEMENT, 4))
    made = F.struct(lemma.alias("lemma"), F.regexp_extract(element, _ELEMENT, 2).alias("target"), begin.alias("begin"), end.alias("end"))
    return F.when(begin.isNotNull() & end.isNotNull(), made)


def decode_links(links: Column) -> Column:
    """All well-formed elements, in order."""
    return F.filter(F.transform(F.split(links, SEPARATOR), decode_link), lambda x: x.isNotNull())


def encode_link(link: Column) -> Column:
    lemma = F.when(link["lemma"].isNotNull(), F.concat(link["lemma"], F.lit(LEMMA_END))).otherwise("")
    return F.concat(lemma, link["target"], F.lit("@"), link["begin"].cast("string"), F.lit(":"), link["end"].cast("string"))


def encode_links(links: Column) -> Column:
    return F.array_join(F.transform(links, encode_link), SEPARATOR)


def columns_of(line: Column) -> Column:
    """Tab-separated columns without trailing empty ones."""
    return F.split(F.regexp_replace(line, r"\t+$", ""), r"\t")


def encode_counts(counts: Column) -> Column:
    """`target:count` elements, each with two blanks behind."""
    return F.array_join(F.transform(counts, lambda x: F.concat(x["target"], F.lit(":"), x["cnt"].cast("string"), F.lit(SEPARATOR))), "")


def decode_count(element: Column) -> Column:
    """`target:count`; the last colon separates, targets may have others."""
    form = r"(?s)^(.*):([0-9]+)$"
    return F.when(element.rlike(form), F.struct(F.regexp_extract(element, form, 1).alias("target"), F.regexp_extract(element, form, 2).try_cast("bigint").alias("cnt")))


def _lines(document: Column) -> Column:
    """(sentence, encoded links) of the lines that have exactly these two columns."""
    rows = F.transform(F.split(document, "\n"), columns_of)
    return F.filter(rows, lambda c: F.size(c) == 2)


def document_text(document: Column) -> Column:
    """The sentences of a document of `sentence TAB links` lines, each with a line break behind."""
    return F.array_join(F.transform(_lines(document), lambda c: F.concat(c[0], F.lit("\n"))), "")


def document_links(document: Column) -> Column:
    """array<struct<begin, end, resource>>: the links of all lines, with spans in document_text; badly formed elements are left out."""

    def moved(line: Column, at: Column) -> Column:
        return F.transform(decode_links(line[1]), lambda x: F.struct((x["begin"] + at).alias("begin"), (x["end"] + at).alias("end"), x["target"].alias("resource")))

    def all_of(rows: Column) -> Column:
        return let(starts_of(F.transform(rows, lambda c: F.length(c[0]) + 1)), lambda at: F.flatten(F.transform(rows, lambda c, k: moved(c, F.get(at, k)))))

    return let(_lines(document), all_of)
