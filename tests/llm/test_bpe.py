import hashlib
import random

import public_tokenizers
import pytest
from regular import both
from tokenizers import Tokenizer

from kgloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(4)
    alphabet = "abcdefghij  \n\t'sté ñ中文字😀123.,!-_<|>\x00\x1c\x85\xa0​　ÀÉ"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    out += ["a" * n for n in range(1, 80)] + ["<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", " " * 50 + "x", "the " * 30_000, "z" * 20_000]
    return out


def test_ids_equal_the_library(library):
    c = bpe.Codec(bpe.read_file(PATH))
    texts = samples()
    for t, mine, theirs in zip(texts, c.pieces.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids, t
        assert c.table.decode(mine).decode("utf-8", "replace") == library.decode(theirs.ids, skip_special_tokens=False)


def test_operator(spark, library):
    texts = [None, "", "Hello world", "Hello world", "x" * 30_000, "über 'll"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "a", 0)], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: r for r in bpe.encoded(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded == (t or "") and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[None].n_tokens == 1
    assert bpe.encoded(docs.limit(0), PATH).count() == 0


def test_regular_words_are_told_apart(library):
    texts = [f"{a}{w} {b}" for n in (1024, 2048, 4096, 8192) for w in both(n) for a, b in (("", ""), ("x ", w[::-1]))]
    c = bpe.Codec(bpe.read_file(PATH))
    for mine, theirs in zip(c.pieces.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids


def test_a_full_table_is_emptied(library):
    c = bpe.Codec(bpe.read_file(PATH))
    c.pieces.most, c.pieces.bits = 5, 3
    c.pieces._empty()
    for t in samples()[:200]:
        assert c.pieces.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
