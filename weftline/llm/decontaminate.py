"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Items and texts are normalised alike: A-Z in lower case, every other ASCII character that is no
digit or letter a separator, words joined by one blank with a blank at either end. The patterns
are all runs of `width` words of an item (an item of fewer words is one pattern), so a pattern
with its blanks occurs in a text exactly where its words do. Each text is scanned once; only texts
with a match get the match ends mapped back to words and to characters of the original.

The automaton is built in each Python worker from a broadcast list of patterns. The list is
counted before it is collected: past `max_patterns` the items are divided by a hash of their text
over several passes, each with its own automaton and written before the next, so that a worker holds one.

Defined cases: null and empty texts have no words and no hits; null or wordless items have no
pattern; items with equal text are all reported; a null item_id counts as an item but is left out
of the list of ids; an empty benchmark contaminates nothing; repeated documents are judged each
for itself; other columns of the input pass through, those named like a result are replaced.
A text may be of any length; it is scanned whole, at about ten times its bytes of memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import lean, materialize, others, pieces, quoted, small_batches
from weftline.llm.wordhash import translation

WIDTH = 10
MAX_PATTERNS = 100_000
#: Everything in ASCII but digits and letters separates words, see the class `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
TABLE = translation(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("n_items", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def item_windows(text: bytes, width: int) -> set[bytes]:
    words = text.translate(TABLE).split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))}


def _patterns(rows: list[tuple[int, str]], width: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Pattern -> its number of words and the numbers of the items that hold it."""
    found: dict[bytes, list[int]] = {}
    for number, text in rows:
        for w in item_windows(text.encode(), width):
            found.setdefault(w, []).append(number)
    return {w.decode(): (w.count(b" ") - 1, tuple(sorted(ns))) for w, ns in found.items()}


class Scanner:
    def __init__(self, rows: list[tuple[int, str]], width: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for w, value in _patterns(rows, width).items():
            self.automaton.add_word(w, value)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged runs [first, last] of hit words, numbers of the items met."""
        words = text.translate(TABLE).split()
        if not words or not self.any:
            return len(words), [], set()
        line = (b" " + b" ".join(words) + b" ").decode()
        matches = list(self.automaton.iter(line))
        if not matches:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 0x20)
        runs: list[tuple[int, int]] = []
        last = np.searchsorted(blanks, [end for end, _ in matches]) - 1
        for a, b in sorted((int(k) - n + 1, int(k)) for k, (_, (n, _)) in zip(last, matches, strict=True)):
            if runs and a <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(runs[-1][1], b))
            else:
                runs.append((a, b))
        return len(words), runs, {i for _, (_, items) in matches for i in items}


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of runs of words; the translation keeps every byte's place."""
    buf = np.frombuffer(b" " + text.translate(TABLE) + b" ", dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(buf.astype(np.int8)))
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"begin": int(lead[edge[2 * a]]), "end": int(lead[edge[2 * b + 1]])} for a, b in runs]


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings), n_items and hits (spans of the original)."""
    small_batches(docs.sparkSession)
    named = items.select(F.col(quoted(item_id)).cast("string").alias("id"), F.col(quoted(item_text)).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    groups = pieces((size["b"] or 0) // 2, max_patterns)  # a window starts at a word, a word has two bytes at least with its blank
    carried = others(docs, text_col, *RESULT.names)
    out = docs.select(*(F.col(quoted(c)) for c in carried), F.col(quoted(text_col)))
    for g in range(groups):
        rows = [(r["id"], r["text"]) for r in named.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).collect()]
        out = _scan(out, docs.sparkSession.sparkContext.broadcast(rows), carried, text_col, width, first=g == 0)
        if g < groups - 1:
            out = materialize(out, "decontaminate")
    return out


_SCANNERS: dict[str, Scanner] = {}


def scanner(name: str, shared, width: int) -> Scanner:
    """The worker's automaton of this name: built once for all its tasks, and alone."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner([(k, t) for k, (_, t) in enumerate(shared.value)], width)
    return _SCANNERS[name]


def _scan(df: DataFrame, shared, carried: list[str], text_col: str, width: int, first: bool) -> DataFrame:
    schema, name = T.StructType([*(df.schema[c] for c in (*carried, text_col)), *RESULT]), uuid.uuid4().hex
    arrow = pa.schema([pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("item_ids", pa.list_(pa.string())), pa.field("n_items", pa.int64()), pa.field("hits", pa.list_(pa.struct([pa.field("begin", pa.int64()), pa.field("end", pa.int64())])))])

    def run(batches):
        ids = [i for i, _ in shared.value]
        scan = scanner(name, shared, width).scan
        for batch in batches:
            earlier = None if first else batch.select(RESULT.names).to_pylist()
            made = []
            texts = batch.column(text_col).cast(pa.binary())
            for k in range(batch.num_rows):
                text = texts[k].as_py() or b""
                n, runs, met = scan(text)
                hits = original_spans(text, runs)
                n_hit, named, n_items = sum(b - a + 1 for a, b in runs), {ids[i] for i in met if ids[i] is not None}, len(met)
                if earlier and earlier[k]["hits"]:
                    spans = [(h["begin"], h["end"]) for h in earlier[k]["hits"]] + [(h["begin"], h["end"]) for h in hits]
                    hits, n_hit = _merged(text, spans)
                    named, n_items = named | set(earlier[k]["item_ids"]), n_items + earlier[k]["n_items"]
                made.append({"n_words": n, "n_hit": n_hit, "item_ids": sorted(named, key=lambda s: s.encode()), "n_items": n_items, "hits": hits})
            new = pa.RecordBatch.from_pylist(made, schema=arrow)
            keep = [batch.column(c) for c in (*carried, text_col)]
            yield pa.RecordBatch.from_arrays([*keep, *new.columns], names=[*carried, text_col, *RESULT.names])

    return df.mapInArrow(lean(run), schema)


def _merged(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[dict[str, int]], int]:
    """Union of word-aligned spans that come from several automata."""
    buf = np.frombuffer(b" " + text.translate(TABLE) + b" ", dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(buf.astype(np.int8)))
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    begins, ends = lead[edge[0::2]], lead[edge[1::2]]
    hit = np.zeros(len(begins) + 1, dtype=np.int64)
    for b, e in spans:
        hit[np.searchsorted(begins, b)] += 1
        hit[np.searchsorted(ends, e) + 1] -= 1
    on = np.concatenate(([False], np.cumsum(hit[:-1]) > 0, [False]))
    at = np.flatnonzero(np.diff(on.astype(np.int8)))
    return [{"begin": int(begins[a]), "end": int(ends[b - 1])} for a, b in zip(at[0::2], at[1::2], strict=True)], int(on.sum())
