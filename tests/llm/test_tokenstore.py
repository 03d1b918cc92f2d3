import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from regular import both
from tokenizers import Tokenizer

from kgloom.llm import tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_crc_combines():
    rng, crc = random.Random(1), tokenstore.Crc()
    for _ in range(200):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert crc.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_streamed_root_equals_tree():
    for n in range(1, 40):
        leaves, r = [bytes([i]) * 32 for i in range(n)], tokenstore._Roots()
        for x in leaves:
            r.add(x)
        assert r.root() == tokenstore.merkle(leaves)


def test_cuts_cover_and_bound():
    ids = np.random.default_rng(2).integers(0, 50_000, 200_000)
    lists = [ids, ids[:10], np.zeros(30_000, dtype=np.int64), ids[:1], ids[150:9000]]
    together = tokenstore._chunked(lists)
    for part, ends in zip(lists, together):
        assert ends == tokenstore._chunked([part])[0]
        assert ends[-1] == len(part) and (np.diff([0, *ends]) <= tokenstore.MOST).all()
    assert 500 < len(ids) / len(together[0]) < 2500


def test_library_pieces_equal_whole_texts():
    rng, lib, plain = random.Random(7), tokenstore.LibraryPieces(tokenstore.read_file(PATH)), Tokenizer.from_file(PATH)
    letters = "abcdefgh  \n\t'sté ñ中文字😀123.,!-_<|>\x00\x1c\x85\xa0​　ÀÉ²½ªº"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]
    for k in range(0, 2000, 100):
        for t, mine in zip(texts[k : k + 100], lib.pieces.encode(texts[k : k + 100])):
            assert mine.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_round_trip(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["the", "thatnd", "onesen", "erblest", "ñandú", "don't", "x1", "\n", "中文", "<|endoftext|>"]
    shared = " ".join(rng.choice(vocab) for _ in range(3000))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(2000))) for _ in range(30)]
    texts += [None, "", shared, "start " + shared, shared + " end", shared, "x" * 20_000]
    rows = [(i * 7 % 101, t, 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    folder = tokenstore.write(docs, PATH, str(tmp_path / "store"))
    lib = Tokenizer.from_file(PATH)
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read_digests(spark, folder, 2).collect()}
    assert got == {w[:4] for w in want}
    assert {(r.doc_id, r.start, tuple(r.ids)) for r in tokenstore.read_ids(spark, folder, 2).collect()} == {(a, b, tuple(e)) for a, b, _, _, e in want}
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    chunks.selectExpr("address", "unhex(reverse(hex(data))) as data").write.parquet(str(tmp_path / "bad/chunks"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(Exception, match="match its address"):
        tokenstore.read_digests(spark, str(tmp_path / "bad"), 2).collect()


def test_empty(spark):
    folder = tokenstore.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert tokenstore.read_digests(spark, folder, 2).count() == 0


def test_regular_words_are_told_apart(spark, tmp_path):
    texts = [f"a {w} b" for n in (1024, 2048, 4096, 8192) for w in both(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = tokenstore.write(docs, PATH, str(tmp_path / "regular"))
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in tokenstore.read_ids(spark, folder, tokenstore.width_of(PATH)).collect()}
    assert got == {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
