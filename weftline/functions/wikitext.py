"""Wikitext to paragraphs of plain text with the spans of internal links.

A small parser for the constructs that carry prose: links, external links, emphasis, headings,
lists, tables (left out), remaining tags. It runs in Arrow batches; what it returns is all that later
steps need, so it runs once a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PARAGRAPHS = "array<struct<text:string,links:array<struct<target:string,begin:int,end:int>>>>"
_TABLE = re.compile(r"^\{\|.*?^\|\}", re.S | re.M)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_RULE = re.compile(r"^\s*(?:={2,6}.*={2,6}|-{4,}|__[A-Z]+__)\s*$")
_PIECE = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]|\[(?:https?|ftp)://\S*\s*([^\]]*)\]|'{2,5}")
# Prefixes of links that point to no article.
_ASIDE = ("file:", "image:", "category:", "media:")


def paragraph(line: str) -> dict | None:
    """Plain text of one paragraph and its internal links; None if nothing is left."""
    out, links, at, length = [], [], 0, 0
    for m in _PIECE.finditer(line):
        plain = html.unescape(line[at : m.start()])
        out.append(plain)
        length += len(plain)
        at = m.end()
        if m[1] is None:
            shown = html.unescape(m[3] or "")
        elif m[1].strip().lower().startswith(_ASIDE):
            shown = ""
        else:
            target = html.unescape(m[1]).strip()
            shown = html.unescape(m[2].rpartition("|")[2] if m[2] is not None else target).replace("'''", "").replace("''", "")
            if target and shown:
                links.append({"target": target.lstrip(":"), "begin": length, "end": length + len(shown)})
        out.append(shown)
        length += len(shown)
    out.append(html.unescape(line[at:]))
    text = "".join(out)
    return {"text": text, "links": links} if text.strip() else None


def parse(text: str | None) -> list[dict]:
    """Paragraphs end at empty lines; headings, rules and tables end them too; list items are paragraphs of their own."""
    found, held = [], []

    def close() -> None:
        if held:
            p = paragraph(" ".join(held))
            if p:
                found.append(p)
            held.clear()

    for line in _TAG.sub("", _TABLE.sub("\n\n", text or "")).split("\n"):
        if not line.strip() or _RULE.match(line):
            close()
        elif line[0] in "*#:;":
            close()
            held.append(line.lstrip("*#:; "))
            close()
        else:
            held.append(line)
    close()
    return found


def paragraphs(cleaned: Column) -> Column:
    """array<struct<text, links: array<struct<target, begin, end>>>> of cleaned markup."""

    kind = to_arrow_type(T._parse_datatype_string(PARAGRAPHS))

    @F.arrow_udf(T._parse_datatype_string(PARAGRAPHS))
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], kind), *_parsed(texts, kind)])

    return run(cleaned)


def _parsed(texts: pa.Array, kind: pa.DataType, size: int = 1 << 20) -> Iterator[pa.Array]:
    """What parse gives for the texts, packed after about `size` characters, so that a batch never stands whole in Python's objects."""
    held, length = [], 0
    for text in texts:
        page = text.as_py() or ""
        held.append(parse(page))
        length += len(page)
        if length >= size:
            yield pa.array(held, kind)
            held, length = [], 0
    yield pa.array(held, kind)
