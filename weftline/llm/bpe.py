"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last 16 bytes has `mask_bits` zero bits, so equal
passages are cut alike wherever they stand. Each distinct chunk is encoded once per Python worker
as long as its memory holds it (of bounded size, in two generations: chunks met again stay);
repeats reuse its pieces. A chunk is kept as its
whole words plus the broken word at either end. At a join the broken ends of two chunks are put
together and re-encoded with one whole word on either side; if the outer words' ids do not agree
with the ids that their chunks hold, the window grows by a word on each side, until exact
agreement; where it spans both chunks without it, the whole text is encoded at once.

Only tokenizers whose file declares steps under which a text's ids are those of its words are
taken (see PlainWords); others, such as byte-level vocabularies that mark blanks, are refused.

Words are what stands between ASCII white space. Within chunks they too are encoded once and
remembered; new words of a batch are encoded together.

Defined cases: null is the empty text (no ids, decoded as ""); a text without white space is one
word; repeated rows are encoded alike; an empty table gives no rows; other columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import lean, others, quoted, slices, small_batches
from weftline.llm.wordhash import byte_values, prefix_sums, raw

MASK_BITS, SPAN = 10, 16
WORDS_KEPT, CHUNK_BYTES_KEPT = 300_000, 32 << 20
RESULTS = ("ids", "n_tokens", "decoded")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def cuts(text: bytes, mask_bits: int = MASK_BITS, span: int = SPAN) -> list[int]:
    """Ends of the chunks of a text: rolling-hash cuts, moved on to the next character's begin, and the end."""
    if len(text) <= span:
        return [len(text)] if text else []
    data = np.frombuffer(text, dtype=np.uint8)
    sums, down = prefix_sums(byte_values(data), 0x9E3779B97F4A7C15)
    h = (sums[span:] - sums[:-span]) * down[: len(sums) - span]
    at = np.flatnonzero((h >> np.uint64(64 - mask_bits)) == 0) + span
    out = []
    for a in at.tolist():
        while a < len(text) and (text[a] & 0xC0) == 0x80:
            a += 1
        if a < len(text) and (not out or a > out[-1]):
            out.append(a)
    return [*out, len(text)]


class Chunk:
    """A chunk's whole words as ids, and the broken words at its ends (head, tail); without a blank it is all head."""

    __slots__ = ("data", "first", "head", "ids", "last", "tail", "whole")

    def __init__(self, data: bytes):
        self.data = data
        blank = _BLANK.search(data)
        self.whole = blank is None
        self.head, self.tail = (data, b"") if blank is None else (data[: blank.start()], data[max(map(data.rfind, _BLANKS)) + 1 :])

    def words(self) -> list[bytes]:
        return [] if self.whole else self.data[len(self.head) : len(self.data) - len(self.tail)].split()

    def learned(self, inner: list[bytes], memory: dict[bytes, bytes]) -> None:
        self.ids = b"".join(map(memory.__getitem__, inner))
        self.first = [(w, memory[w]) for w in inner[:1]]
        self.last = [(w, memory[w]) for w in inner[-1:]]


#: Printable characters below U+0130: in NFC as they stand, none is white space, lower case is one character for one.
_SIMPLE = re.compile("[!-~\u00a1-\u012f]+")


class Memory(dict):
    """A dict of bounded size in two generations: entries that are used again outlive a full generation, all others go."""

    def __init__(self, kept: int):
        super().__init__()
        self.kept, self.older = kept, {}

    def __missing__(self, key):
        value = self.older[key]
        self[key] = value
        return value

    def holds(self, key) -> bool:
        """Whether it is there; what an older generation has moves up."""
        if key in self:
            return True
        value = self.older.get(key)
        if value is None:
            return False
        self[key] = value
        return True

    def turn(self, coming: int) -> None:
        """Room for as many entries that are about to come, none of which goes before the next turn."""
        if len(self) + coming > self.kept:
            self.older = dict(self)
            self.clear()


class PlainWords:
    """Ids of simple words straight from the merges, past normaliser and pre-tokeniser.

    Only for tokenizers whose file declares the steps that this reproduces: NFC, white space
    to blanks and lower case; then one pattern whose matches are the pieces, each as bytes.
    All other words go through the tokenizer itself.
    """

    def __init__(self, tokenizer, declared: dict, kept: int):
        self.model, self.memory = tokenizer.model, Memory(kept)
        self.pattern = self.bytes = None
        norm, pre = (declared.get("normalizer") or {}).get("normalizers", []), (declared.get("pre_tokenizer") or {}).get("pretokenizers", [])
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in norm]
        wanted = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        if steps == wanted and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and "Regex" in pre[0]["pattern"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and declared.get("post_processor") is None:
            self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
            self.special = [t["content"] for t in declared.get("added_tokens", [])]
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            self.numbers = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]
            self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def learn(self, words: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Enters the ids of the simple ones of the words; returns the others."""
        rest, memory, numbers, tokenize, find = [], self.memory, self.numbers, self.model.tokenize, self.pattern.findall
        memory.turn(2 * len(words))
        for w in words:
            word = w.decode()
            simple = word.isprintable() if word.isascii() else _SIMPLE.fullmatch(word)
            if not simple or ("<" in word and any(t in word for t in self.special)):
                rest.append(w)
                continue
            low, out = word.lower(), []
            for piece in (low,) if low.isalpha() else find(low):
                if piece not in memory and not memory.holds(piece):
                    shown = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
                    memory[piece] = b"".join([numbers[t.id] for t in tokenize(shown)])
                out.append(memory[piece])
            into[w] = out[0] if len(out) == 1 else b"".join(out)
        return rest


class Codec:
    """Encodes and decodes as the tokenizer does, reusing chunks and words."""

    def __init__(self, path: str, mask_bits: int = MASK_BITS, words_kept: int = WORDS_KEPT, chunk_bytes_kept: int = CHUNK_BYTES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        self.simple = PlainWords(self.tokenizer, {k: v for k, v in declared.items() if k != "model"}, words_kept // 2)
        if self.simple.pattern is None:
            raise ValueError(f"{path}: a text's ids are not those of its words by the steps that this tokenizer declares")
        self.mask_bits, self.words_kept, self.chunk_bytes_kept = mask_bits, words_kept, chunk_bytes_kept
        self.words = Memory(words_kept)
        self.chunks: dict[bytes, Chunk] = {}
        self.older: dict[bytes, Chunk] = {}
        self.chunk_bytes = 0
        self.plain = self.tokenizer.decoder is None
        self.pieces: list[str | None] = [self.tokenizer.id_to_token(i) for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)] if self.plain else []
        self.seen = self.reused = self.joins = self.widened = 0

    def _ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """After this, self.words has all of them."""
        self.words.turn(len(words))
        known = self.words
        new = self.simple.learn([w for w in words if w not in known and not known.holds(w)], known)
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _joined(self, before: Chunk | None, broken: bytes, after: Chunk | None) -> bytes | None:
        """Ids of what a cut broke, re-encoded between neighbours whose ids must come out as their chunks hold them; None where they never do."""
        self.joins += 1
        left, right = before.last if before else [], after.first if after else []
        reach = 1
        while True:
            window = self._ids(b" ".join([*(w for w, _ in left), *([broken] if broken else []), *(w for w, _ in right)]))
            outer_left, outer_right = b"".join(i for _, i in left), b"".join(i for _, i in right)
            end = len(window) - len(outer_right)
            if len(outer_left) <= end and window.startswith(outer_left) and window.endswith(outer_right):
                return window[len(outer_left) : end]
            before_words, after_words = before.words() if before else [], after.words() if after else []
            if reach >= max(len(before_words), len(after_words)):
                return None
            reach *= 2
            self.widened += 1
            left, right = [(w, self._ids(w)) for w in before_words[-reach:]], [(w, self._ids(w)) for w in after_words[:reach]]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split, met, needed, new = [], {}, set(), []
        for text in texts:
            ends = cuts(text, self.mask_bits)
            chunks = []
            for a, b in zip([0, *ends], ends, strict=False):
                data = text[a:b]
                self.seen += 1
                c = self.chunks.get(data) or met.get(data)
                if c is None and data in self.older:
                    c = self.older[data]
                    self.keep(c)
                if c is None:
                    met[data] = c = Chunk(data)
                    inner = c.words()
                    new.append((c, inner))
                    needed.update(inner)
                else:
                    self.reused += 1
                chunks.append(c)
            split.append(chunks)
            if chunks:
                needed.update(w for w in (chunks[0].head, chunks[-1].tail) if w)
        self.learn(needed)
        for c, inner in new:
            c.learned(inner, self.words)
        out = []
        for text, chunks in zip(texts, split, strict=True):
            made: list[bytes | None] = []
            broken, before, joined = b"", None, False
            for k, c in enumerate(chunks):
                broken += c.head
                joined |= k > 0
                if c.whole:
                    continue
                made += [self._joined(before, broken, c) if joined else self.words[broken] if broken else b"", c.ids]
                broken, before, joined = c.tail, c, False
            if broken:
                made.append(self._joined(before, broken, None) if joined else self.words[broken])
            out.append(self._ids(text) if None in made else b"".join(made))
        for c, _ in new:
            self.keep(c)
        return out

    def keep(self, c: Chunk) -> None:
        """Into the younger generation; when that is full it becomes the older one, and what the older one had goes."""
        size = len(c.data) + len(c.ids) + 500
        if self.chunk_bytes + size > self.chunk_bytes_kept // 2:
            self.older, self.chunks, self.chunk_bytes = self.chunks, {}, 0
        self.chunk_bytes += size
        self.chunks[c.data] = c

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if self.plain:
            return " ".join([p for p in map(self.pieces.__getitem__, numbers) if p is not None])
        return self.tokenizer.decode(numbers, skip_special_tokens=False)


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, **settings) -> Codec:
    """The worker's codec: what it remembers serves all tasks of the worker."""
    key = (path, *sorted(settings.items()))
    if key not in _CODECS:
        _CODECS[key] = Codec(path, **settings)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", decode: bool = True, keep_text: bool = True, digest=None, digest_fields: tuple[tuple[str, str], ...] = (), **settings) -> DataFrame:
    """docs with ids (array<int>), n_tokens and, if asked, decoded.

    With `digest`, a function of (ids as bytes, decoded text), its values stand in the columns
    `digest_fields` instead of ids and decoded, so that what a caller only sums up never leaves
    the worker.
    """
    small_batches(docs.sparkSession)
    made = [T.StructField("n_tokens", T.LongType())]
    if digest is None:
        made += [T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=False)), *([T.StructField("decoded", T.StringType())] if decode else [])]
    else:
        made += [T.StructField(n, T._parse_datatype_string(t)) for n, t in digest_fields]
    carried = others(docs, text_col, *(f.name for f in made)) + ([text_col] if keep_text else [])
    schema = T.StructType([*(docs.schema[c] for c in carried), *made])
    read = list(dict.fromkeys([*carried, text_col]))

    def run(batches):
        c = codec(path, **settings)
        for batch in batches:
            texts = raw(batch.column(text_col))
            for a, b in slices(texts):
                ids = c.encode_many(texts[a:b])
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                plain = [c.decode(i) for i in ids] if decode else [None] * len(ids)
                if digest is None:
                    flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                    ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                    new = [n, pa.ListArray.from_arrays(pa.array(ends), flat), *([pa.array(plain, pa.string())] if decode else [])]
                else:
                    rows = [digest(i, d) for i, d in zip(ids, plain, strict=True)]
                    new = [n, *(pa.array([r[k] for r in rows]) for k in range(len(digest_fields)))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in carried), *new], names=schema.names)

    return docs.select(*(F.col(quoted(x)) for x in read)).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded: the text of each row's ids; null ids give ""."""
    carried = others(encoded, "decoded")
    schema = T.StructType([*(encoded.schema[c] for c in carried), T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(i or [], dtype="<u4").tobytes()) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*(F.col(quoted(x)) for x in carried)).mapInArrow(lean(run), schema)
