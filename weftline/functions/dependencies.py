"""Dependency edges as arrays of structs: collapsed prepositions, context features, patterns, triples.

Edges are {gov, dep, type, begin, end} with token numbers; parses come from the user's parser. The
array forms are JVM higher-order functions; only pattern matching over trees is Python, in Arrow
batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schema import DEPENDENCY, TRIPLE

HOLE = "@@"
MAX_DEPTH = 10


def bims(deps: Column, tokens: Column, word: Column) -> Column:
    """Features of the token number `word`: `rel(@@,lemma)` where it governs, `rel(lemma,@@)` where it depends; both for a loop."""
    lemma = lambda i: F.get(tokens, i)["lemma"]
    mine = F.filter(deps, lambda e: (e["gov"] == word) | (e["dep"] == word))
    governs = lambda e: F.when(e["gov"] == word, F.concat(e["type"], F.lit(f"({HOLE},"), lemma(e["dep"]), F.lit(")")))
    depends = lambda e: F.when(e["dep"] == word, F.concat(e["type"], F.lit("("), lemma(e["gov"]), F.lit(f",{HOLE})")))
    return F.filter(F.flatten(F.transform(mine, lambda e: F.array(governs(e), depends(e)))), lambda x: x.isNotNull())


def holing(deps: Column, tokens: Column) -> Column:
    """Two features an edge: the governor with the hole at 0, the dependent with the hole at 1."""
    lemma = lambda i: F.get(tokens, i)["lemma"]
    one = lambda key, value, e, hole: F.struct(lemma(key).alias("key"), F.array(lemma(value)).alias("values"), e["type"].alias("relation"), F.lit(hole).alias("hole"))
    return F.flatten(F.transform(deps, lambda e: F.array(one(e["gov"], e["dep"], e, 0), one(e["dep"], e["gov"], e, 1))))


def collapse_prepositions(deps: Column, tokens: Column) -> Column:
    """Edges through a preposition become one edge named after it.

    For a token tagged IN with a `prep` edge from a governor and a `pobj` edge to an object, both
    edges give way to governor -> object of type `prep_<token>`; a multi-word preposition (an
    `mwe` dependent) is named `prep_<dependent>_<token>`. Prepositions without both edges stay.
    """
    number = F.sequence(F.lit(0), F.size(tokens) - 1)
    token = lambda i: F.get(tokens, i)
    first = lambda a: F.get(a, F.lit(0))
    numbered = F.when(F.size(tokens) > 0, number).otherwise(F.array().cast("array<int>"))

    def plan(i: Column) -> Column:
        def edges(kind: str, end: str) -> Column:
            return F.filter(deps, lambda e: (e[end] == i) & (e["type"] == kind))

        into, out, more = edges("prep", "dep"), edges("pobj", "gov"), edges("mwe", "gov")
        name = F.concat(F.lit("prep_"), F.when(F.size(more) > 0, F.concat(F.lower(token(first(more)["dep"])["text"]), F.lit("_"))).otherwise(""), F.lower(token(i)["text"]))
        edge = F.struct(first(into)["gov"].alias("gov"), first(out)["dep"].alias("dep"), name.alias("type"), first(into)["begin"].alias("begin"), first(out)["end"].alias("end"))
        return F.when((F.size(into) > 0) & (F.size(out) > 0), F.struct(i.alias("i"), edge.alias("edge")))

    plans = F.filter(F.transform(F.filter(numbered, lambda i: token(i)["pos"] == "IN"), plan), lambda p: p.isNotNull())
    spent = lambda e: F.exists(plans, lambda p: ((e["type"] == "prep") & (e["dep"] == p["i"])) | ((e["type"] == "pobj") & (e["gov"] == p["i"])) | ((e["type"] == "mwe") & (e["gov"] == p["i"])))
    return F.concat(F.filter(deps, lambda e: ~spent(e)), F.transform(plans, lambda p: p["edge"])).cast(f"array<{DEPENDENCY}>")


# Which relation is a kind of which, as in the public hierarchy of English dependencies.
PARENT_RELATION = {
    "nsubj": "subj", "csubj": "subj", "nsubjpass": "nsubj", "csubjpass": "csubj", "xsubj": "subj", "subj": "arg",
    "dobj": "obj", "iobj": "obj", "pobj": "obj", "obj": "comp", "attr": "comp", "ccomp": "comp", "xcomp": "comp", "acomp": "comp", "pcomp": "comp", "comp": "arg",
    "agent": "arg", "arg": "dep", "amod": "mod", "advmod": "mod", "nn": "mod", "num": "mod", "appos": "mod", "poss": "mod", "rcmod": "mod", "partmod": "mod", "infmod": "mod",
    "advcl": "mod", "tmod": "mod", "det": "mod", "predet": "mod", "preconj": "mod", "quantmod": "mod", "neg": "advmod", "prep": "mod", "prepc": "mod", "prt": "mod", "mwe": "mod", "mod": "dep",
    "aux": "dep", "auxpass": "aux", "cop": "aux", "conj": "dep", "cc": "dep", "punct": "dep", "ref": "dep", "expl": "mod", "mark": "mod", "possessive": "mod", "parataxis": "dep",
}


@dataclass(frozen=True)
class Pattern:
    """Roles for subject, predicate, object; alternatives for governor, relation, dependent."""

    roles: tuple[str, str, str]
    governor: tuple[tuple[re.Pattern, re.Pattern | None], ...]
    relation: tuple[tuple[re.Pattern, re.Pattern | None], ...]
    dependent: tuple[tuple[re.Pattern, re.Pattern | None], ...]

    @property
    def veto(self) -> bool:
        return self.roles == ("?", "?", "?")


def _alternatives(text: str, separator: str) -> tuple:
    glob = lambda x: re.compile(x.replace("*", ".*"))
    out = []
    for part in text.split("|"):
        name, found, more = part.partition(separator)
        out.append((glob(name), glob(more) if found else None))
    return tuple(out)


def parse_patterns(lines: str) -> list[Pattern]:
    """`roles TAB governor relation dependent`, three words each; // begins a comment.

    Roles: x, y, z (governor's parent, governor, dependent), * (nothing), ? (as before). Nodes:
    `lemma#tag`, relations: `name_specific`; | separates alternatives, * stands for anything.
    """
    out = []
    for line in lines.splitlines():
        line = line.split("//")[0].rstrip()
        if not line.strip():
            continue
        roles, _, tree = line.partition("\t")
        y, rel, z = tree.split()
        given = tuple(roles.split())
        if len(given) != 3 or any(r not in "xyz*?" for r in given):
            raise ValueError(f"not three roles: {line!r}")
        out.append(Pattern(given, _alternatives(y, "#"), _alternatives(rel, "_"), _alternatives(z, "#")))
    return out


def _node(alternatives: tuple, token: dict) -> bool:
    lemma, tag = token["lemma"].lower(), token["pos"].lower()
    return any(a.fullmatch(lemma) and (t is None or t.fullmatch(tag)) for a, t in alternatives)


def _relation(alternatives: tuple, kind: str) -> bool:
    """The relation or any it is a kind of; what follows _ is its specific part."""
    name, _, specific = kind.partition("_")
    lineage, at = [name], name
    while at in PARENT_RELATION and PARENT_RELATION[at] not in lineage:
        at = PARENT_RELATION[at]
        lineage.append(at)
    return any(any(a.fullmatch(n) for n in lineage) and (s is None or (specific and s.fullmatch(specific))) for a, s in alternatives)


def proper_noun(tokens: list[dict], i: int) -> bool:
    """Tagged NNP, or with an initial in upper case beyond the first word."""
    return tokens[i]["pos"].startswith("NNP") or (i > 0 and tokens[i]["text"][:1].isupper())


def extract_triples(tokens: list[dict], deps: list[dict], patterns: list[Pattern], max_depth: int = MAX_DEPTH) -> list[dict]:
    """Triples of lemmas from the tree, children before their governors.

    Walking on from a node its roles fill up child by child, each by the first pattern that fits;
    a veto leaves them as they are. After each child a triple is noted if subject and object are
    set. Proper nouns are leaves. Beyond max_depth the walk ends with what it has.
    """
    children: dict[int, list[tuple[int, str]]] = {}
    parent: dict[int, int] = {}
    for e in deps:
        if e["gov"] != e["dep"]:
            children.setdefault(e["gov"], []).append((e["dep"], e["type"]))
            parent.setdefault(e["dep"], e["gov"])
    roots = [i for i in range(len(tokens)) if i in children and i not in parent]
    if not roots:
        return []
    found: list[dict] = []
    lemma = lambda i: None if i is None else tokens[i]["lemma"]
    # An explicit stack: [node, depth, children left, roles, child whose subtree is done].
    stack = [[roots[0], 0, iter(children[roots[0]]), [None, None, None], None]]
    if proper_noun(tokens, roots[0]):
        return []
    while stack:
        node, depth, left, roles, done = stack[-1]
        if done is not None:
            z, kind = done
            here = {"x": parent.get(node), "y": node, "z": z}
            for p in patterns:
                if ("x" in p.roles and here["x"] is None) or not (_node(p.governor, tokens[node]) and _relation(p.relation, kind) and _node(p.dependent, tokens[z])):
                    continue
                if not p.veto:
                    roles[:] = [old if r == "?" else None if r == "*" else here[r] for r, old in zip(p.roles, roles, strict=True)]
                break
            if roles[0] is not None and roles[2] is not None:
                found.append({"subject": lemma(roles[0]), "predicate": lemma(roles[1]), "object": lemma(roles[2])})
            stack[-1][4] = None
        following = next(left, None)
        if following is None:
            stack.pop()
            continue
        stack[-1][4] = following
        if depth + 1 > max_depth:
            return found
        if not proper_noun(tokens, following[0]):
            stack.append([following[0], depth + 1, iter(children.get(following[0], [])), [None, None, None], None])
    return found


def triples(tokens: Column, deps: Column, patterns: list[Pattern]) -> Column:
    """array<struct<subject, predicate, object>> of each sentence."""

    @F.pandas_udf(T._parse_datatype_string(f"array<{TRIPLE}>"))
    def run(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([[] if a is None or b is None else extract_triples(list(a), list(b), patterns) for a, b in zip(t, d, strict=True)], dtype=object)

    return run(tokens, deps)
