import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import bpe
from weftline.llm.queries import tokenizer_path
from weftline.llm.shared import slices


def texts(spark):
    rnd = random.Random(2)
    out = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out += [None, "", " ", "\n\t ", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z<|endoftext|", "it's we'll I'D don'T", "x y z\u0085w\x1cv\x1fu", "é ́e İ ΣΣς ẞﬁ", "\U0001f600 中文 กำ", "\x00\x01\x7f\xad", "a" * 9000, "word " * 4000, "é" * 5000, "1234567 89½²"]
    alphabet = ["a", "B", " ", "\n", "'", "s", "é", "́", "\U0001f600", "9", ".", "<|endoftext|>", " ", "\x1c"]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400))) for _ in range(150)]
    return out


def test_equals_the_library(spark):
    """With cuts every 8 bytes or so nearly every word is broken and repaired."""
    whole = texts(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in whole]
    for settings in ({}, {"mask_bits": 3}, {"mask_bits": 5, "words_kept": 300, "chunk_bytes_kept": 3000}):
        codec = bpe.Codec(tokenizer_path(), **settings)
        for a, b in slices([(t or "").encode() for t in whole], 20_000):
            for t, ids, want in zip(whole[a:b], codec.encode_many([(t or "").encode() for t in whole[a:b]]), wanted[a:b], strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
                assert codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)
        assert codec.joins and codec.reused


def test_shared_passages_are_cut_alike():
    rnd = random.Random(1)
    passage = bytes(rnd.choice(b"abcdefgh ") for _ in range(30_000))
    ends = [set(bpe.cuts(lead + passage)) for lead in (b"", b"other text before ")]
    shifted = {e - 18 for e in ends[1]}
    assert len(ends[0] & shifted) >= 0.9 * len(ends[0]) > 10


def test_operator(spark):
    rows = [(1, "a b", 5), (None, None, 6), (3, "x " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode(df, tokenizer_path()).collect()
    assert [(r["doc_id"], r["n_tokens"], len(r["ids"])) for r in out] == [(1, 2, 2), (None, 0, 0), (3, 3000, 3000)]
    again = bpe.decode(bpe.encode(df, tokenizer_path(), decode=False), tokenizer_path()).collect()
    assert [r["decoded"] for r in again] == [r["decoded"] for r in out] and out[0]["decoded"] == "a</w> b</w>"
    assert bpe.encode(spark.createDataFrame([], "text string"), tokenizer_path()).count() == 0


def test_tokenizers_that_mark_blanks_are_refused():
    with pytest.raises(ValueError, match="declares"):
        bpe.Codec(tokenizer_path("byte_bpe_50k.json"))


def test_chunks_met_again_stay_in_memory():
    rnd = random.Random(4)
    passage = " ".join(f"w{rnd.randrange(1000)}" for _ in range(2000)).encode()
    codec = bpe.Codec(tokenizer_path(), chunk_bytes_kept=400_000)
    for _ in range(30):
        codec.encode_many([passage + b" " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(2000)).encode()])
    assert codec.reused > 0.3 * codec.seen and codec.chunk_bytes <= 200_000
