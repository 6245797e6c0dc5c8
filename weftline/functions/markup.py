"""Cleaning of page markup, as column expressions that stay inside the JVM.

Nested constructs are removed from the inside out until nothing changes: three passes are written
out, and texts that still match go on in a fold with as many further passes as they have closing
marks, which is always enough.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is not prose, in the order in which they are removed.
TAGS = (
    "gallery", "nowiki", "pre", "categorytree", "charinsert", "hiero", "imagemap", "inputbox",
    "math", "poem", "ref", "references", "score", "syntaxhighlight", "source", "timeline",
)
# The patterns whose matches define what is removed.
COMMENT = r"(?s)<!--.*?(-{2,3})>"
TEMPLATE = r"(?s)\{\{([^{]*?)\}\}"
NOWRAP = r"(?s)\{\{nowrap\|([^{]*?)\}\}"


def _bound(text: Column, body) -> Column:
    """body(x) with x evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(text), body), 1)


def until_stable(text: Column, pattern: str, closing: str, passes: int = 3) -> Column:
    """All matches removed, again and again, until none is left."""
    for _ in range(passes):
        text = F.regexp_replace(text, pattern, "")
    rest = lambda x: F.when(
        F.regexp_count(x, F.lit(pattern)) > 0,
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.regexp_count(x, F.lit(re.escape(closing))), F.lit(1))), x, lambda acc, _: F.regexp_replace(acc, pattern, "")),
    ).otherwise(x)
    return _bound(text, rest)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def plain_entities(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&#8209;"), F.lit("-"))


def unwrap_nowrap(text: Column) -> Column:
    return F.regexp_replace(text, NOWRAP, "$1")


def strip_tag(text: Column, tag: str) -> Column:
    """The element's self-closing form, once, then its pairs from the inside out. Longer names that begin alike count too."""
    alone = F.regexp_replace(text, rf"(?s)<{tag}([^<]*?)/>", "")
    return until_stable(alone, rf"(?s)<{tag}([^<]*?)>([^<]*?)</{tag}>", f"</{tag}>")


def strip_tags(text: Column, tags: tuple[str, ...] = TAGS) -> Column:
    def without(tag: str):
        return lambda x: F.when(F.instr(x, f"<{tag}") > 0, strip_tag(x, tag)).otherwise(x)

    for tag in tags:
        text = _bound(text, without(tag))
    return text


def strip_templates(text: Column) -> Column:
    return until_stable(text, TEMPLATE, "}}")


def strip_indented(text: Column) -> Column:
    """Lines that begin with a blank, with the line break before them."""
    return F.regexp_replace(text, r"\n .*", "")


def clean_markup(text: Column) -> Column:
    """All of the above, in this order: comments, entities, nowrap, elements, templates, indented lines."""
    return strip_indented(strip_templates(strip_tags(unwrap_nowrap(plain_entities(strip_comments(text))))))
