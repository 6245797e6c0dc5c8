"""Names of pages: their written form, fragments and lengths. All are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_resource_name(name: Column) -> Column:
    """First letter in upper case, blanks to underscores; other letters stay.

    A letter whose upper case has several characters, or that needs two UTF-16 units, stays as it
    is. "" stays "".
    """
    first = F.substring(name, 1, 1)
    upper = F.when((F.length(F.upper(first)) == 1) & (F.octet_length(first) < 4), F.upper(first)).otherwise(first)
    return F.translate(F.concat(upper, F.substr(name, F.lit(2))), " ", "_")


def legacy_name(name: Column) -> Column:
    """Blanks to underscores only."""
    return F.translate(name, " ", "_")


def strip_fragment(target: Column) -> Column:
    """Up to the first #."""
    return F.substring_index(target, "#", 1)


def fragment(target: Column) -> Column:
    """From the first # on, or ""."""
    return F.substr(target, F.length(strip_fragment(target)) + 1)


def redirected(target: Column, destination: Column, keep_fragment: bool = False) -> Column:
    """The page that target leads to, where destination is what its bare name redirects to (null: nothing).

    Without keep_fragment neither fragment survives. With it, target's fragment is put behind; the
    redirect's own fragment survives only where target has none.
    """
    bare, own = strip_fragment(target), fragment(target)
    if not keep_fragment:
        return F.coalesce(strip_fragment(destination), bare)
    return F.concat(F.coalesce(F.when(F.length(own) > 0, strip_fragment(destination)).otherwise(destination), bare), own)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, for spans that other tools counted so."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def starts_lower(word: Column) -> Column:
    """Initial in lower case and no blank inside."""
    return word.rlike(r"^\p{Ll}") & (F.instr(word, " ") == 0)
