"""Byte-level BPE by backtracking: exact merges in linear time, and decoding through an offset table.

A text is cut at special tokens and into pre-tokens; each pre-token is encoded on its own. The encoder takes, from an
Aho-Corasick automaton over the vocabulary, the longest token at every place. It appends a token only if it is
compatible with the token before it: if encoding the two together gives just these two. Where the longest token is
not, its longest proper prefix that is a token is tried, and so on; where none fits, the place is marked as dead and
the last token is taken back. No place is entered twice, so the work is linear in the length, and the sequence found
is the one that merging by rank gives.

Compatibility comes from the merge ranks: a left token's right edge and a right token's left edge each pass through a
chain of parts as merging goes on; two parts that are at the border at the same time and have a merge of their own
would have been merged across it.

Defined results: null and empty texts have no ids and decode to an empty text. Special tokens in a text are encoded as
their ids, as the tokenizers library does by default. Repeated rows are returned each; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import each, hashed, texts_of, tidy, tune

#: Fixed value: the pre-token pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_BITS, TABLE_IDS, MOST_PAIRS = 21, 6_000_000, 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Classes of characters: other, letter, number, white space.
OTHER, LETTER, NUMBER, SPACE = range(4)
APOSTROPHE, BLANK = ord("'"), ord(" ")


@functools.cache
def character_classes() -> np.ndarray:
    """The class of each code point, as the pattern's own classes have it."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for run in regex.findall(name + "+", every):
            found = np.frombuffer(run.encode("utf-32-le"), dtype="<u4")
            out[found] = kind
    return out


def cut_pieces(codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of many texts, laid end to end as code points: where PATTERN would begin its matches.

    A pre-token is a run of one class with one blank before it; of white space before other characters the last one stands
    alone or, if it is a blank, goes with them; an apostrophe that begins a match takes its contraction with it."""
    n = len(codes)
    kind = character_classes()[codes]
    opens = np.zeros(n + 1, dtype=bool)  # a text begins here; the end counts as one
    opens[text_start] = opens[n] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before other characters of the same text.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
    start[last] = True
    start[last + 1] = codes[last] != BLANK
    # Contractions: an apostrophe that begins a match, and letters of the same text after it.
    at = np.flatnonzero((codes == APOSTROPHE) & start)
    if len(at):
        after = lambda k: np.where(at + k < n, codes[np.minimum(at + k, n - 1)], 0)
        joint = lambda k: ~opens[np.minimum(at + k, n)]
        one, two = after(1), after(2)
        is_ = lambda c, letters: np.isin(c, [ord(x) for x in letters])
        short = joint(1) & is_(one, "stmd")
        long = joint(1) & joint(2) & ~short & (((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))))
        for some, size in ((at[short], 2), (at[long], 3)):
            start[some + 1] = False
            end = some + size
            end = end[end < n]
            start[end[kind[end] == LETTER]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * self.size
        for k, v in vocab.items():
            self.token[v] = k
        for k, v in self.special.items():
            self.token[v] = k.encode()
        self.ids = vocab
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), rank)
            if made not in self.parts:
                self.parts[made], self.born[made] = (left, right), rank


class Encoder:
    """The backtracking encoder of one vocabulary."""

    NEVER = 1 << 60

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(part, rank at which it comes to be, rank at which it is merged into the next) along an edge, whole token first."""
        out, until = [], self.NEVER
        while True:
            born = self.v.born.get(token, -1)
            out.append((token, born, until))
            if token not in self.v.parts:
                return out
            token, until = self.v.parts[token][side], born

    def compatible(self, left: int, right: int) -> bool:
        """Whether these two, side by side, stay apart: an entry of the pair table, filled when first asked for."""
        known = self.fits.get((left, right))
        if known is None:
            a, b, i, j, known = self._edge(left, 1), self._edge(right, 0), 0, 0, True
            while True:
                (x, born_x, until_x), (y, born_y, until_y) = a[i], b[j]
                rank = self.v.merge.get((x, y))
                # At equal ranks merging goes from left to right, so the left token's own merge comes first.
                if rank is not None and max(born_x, born_y) < rank < until_x and rank <= until_y:
                    known = False
                    break
                if born_x < 0 and born_y < 0:
                    break
                if born_x >= born_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _prefix(self, token: int) -> int | None:
        if token not in self.shorter:
            text = self.v.token[token]
            self.shorter[token] = next((self.v.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.v.ids), None)
        return self.shorter[token]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.v.ids.get(piece)
        if len(piece) < 2:
            return [] if whole is None else [whole]
        n = len(piece)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            if size > longest[end - size + 1][0]:
                longest[end - size + 1] = (size, token)
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1]
        while at < n:
            while token is not None:
                end = at + len(self.v.token[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self._prefix(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else None
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(self.v.token[last])
                token = self._prefix(last)
        return out


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, one range after the other."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)


def grown(array: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """The array with new values at place `used`, doubled as often as that takes."""
    while used + len(new) > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    array[used : used + len(new)] = new
    return array


class Pieces:
    """Pre-tokens of many texts at once, and a table of the ids of those met before.

    `many` encodes new pre-tokens, each to little-endian unsigned 32-bit ids. The pre-tokens of a call are told apart by their
    bytes. The table is an array with two places for each 64-bit hash, and holds the bytes too: only a pre-token of equal bytes is found. One that
    is found at neither place is encoded, and takes the first if that is free, else the second. The table is emptied when it
    holds `most` ids or bytes or more."""

    def __init__(self, special: dict[str, int], many: Callable[[list[str]], list[bytes]], bits: int = TABLE_BITS, most: int = TABLE_IDS):
        self.many, self.bits, self.most = many, bits, most
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.special = special
        self._empty()

    def _empty(self) -> None:
        self.key = np.zeros(1 << self.bits, dtype=np.uint64)
        self.begin, self.size, self.byte, self.bytes = (np.zeros(1 << self.bits, dtype=np.int32) for _ in range(4))
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.text, self.written = np.zeros(1 << 16, dtype=np.uint8), 0

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.uint64(64 - self.bits)
        return (h >> top).astype(np.int64), ((h << np.uint64(self.bits)) >> top).astype(np.int64)

    def _known(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each pre-token in the table, -1 without one."""
        one, two = self._places(h)
        place = np.where(self.key[one] == h, one, np.where(self.key[two] == h, two, -1))
        some = np.flatnonzero((place >= 0) & (self.bytes[place] == size))
        if len(some):
            at, n = place[some], size[some]
            same = self.text[spread(self.byte[at].astype(np.int64), n)] == data[spread(start[some], n)]
            some = some[np.logical_and.reduceat(same, np.cumsum(n) - n)]
        out = np.full(len(h), -1)
        out[some] = place[some]
        return out

    def _learn(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pre-tokens and put them into the table; their ranges among the ids."""
        encoded = self.many([data[a : a + n].tobytes().decode() for a, n in zip(start.tolist(), length.tolist(), strict=True)])
        size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        new, letters = np.frombuffer(b"".join(encoded), dtype="<u4"), data[spread(start, length)]
        begin, byte = self.used + np.cumsum(size) - size, self.written + np.cumsum(length) - length
        self.ids, self.text = grown(self.ids, self.used, new), grown(self.text, self.written, letters)
        self.used, self.written = self.used + len(new), self.written + len(letters)
        one, two = self._places(h)
        at = np.where(self.key[one] == 0, one, two)
        at, first = np.unique(at, return_index=True)  # of several for one place the first takes it
        self.key[at], self.begin[at], self.size[at], self.byte[at], self.bytes[at] = h[first], begin[first], size[first], byte[first], length[first]
        return begin, size

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text_start = np.cumsum(length) - length
        line = "".join(texts)
        if not line:
            return [np.zeros(0, dtype="<u4") for _ in texts]
        codes = np.frombuffer(line.encode("utf-32-le"), dtype="<u4")
        start = cut_pieces(codes, text_start[length > 0])
        data = line.encode()
        if len(data) == len(codes):
            offsets = np.append(start, len(codes))
        else:  # where each pre-token begins among the bytes
            offsets = np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[start], len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, (_, bounds, letters) = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary.buffers()
        bounds, letters = np.frombuffer(bounds, dtype=np.int64)[: len(pieces.dictionary) + 1], np.frombuffer(letters, dtype=np.uint8)
        if max(self.used, self.written) >= self.most:
            self._empty()
        first, many = bounds[:-1], np.diff(bounds)
        h = np.maximum(hashed(letters, first, bounds[1:]), np.uint64(1))  # 0 marks a free place
        place = self._known(letters, first, many, h)
        begin, size = self.begin[place].astype(np.int64), self.size[place].astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            begin[new], size[new] = self._learn(letters, first[new], many[new], h[new])
        begin, size = begin[which], size[which]
        end = np.append(0, np.cumsum(size))
        ids = self.ids[spread(begin, size)]
        ends = end[np.searchsorted(start, np.append(text_start, len(codes)))]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return self._encode_plain(texts)
        parts = [self.cut(t) for t in texts]
        plain = iter(self._encode_plain([p for c in parts for p in c[::2]]))
        mark = lambda p: np.array([self.special[p]], dtype="<u4")
        return [np.concatenate([mark(p) if k % 2 else next(plain) for k, p in enumerate(c)]) for c in parts]


class OffsetTable:
    """Decoding: the bytes of all tokens end to end, and where each token begins."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.begin = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        size = self.size[ids]
        stop = np.cumsum(size)
        shift = np.repeat(self.begin[ids] - (stop - size), size)
        return self.data[np.arange(len(shift)) + shift].tobytes()


class Codec:
    """Encoder, decoder and decimal strings of one vocabulary file."""

    def __init__(self, source: str):
        v = Vocabulary(source)
        encoder = Encoder(v)
        self.pieces = Pieces(v.special, lambda new: [np.array(encoder.encode(x.encode()), dtype="<u4").tobytes() for x in new])
        self.table = OffsetTable(v.token)
        self.decimal = [str(i) for i in range(v.size)]


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: What `encoded` can return of each text.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def _columns(c: Codec, texts: list[str], wanted: tuple[str, ...]) -> Iterator[pa.Array]:
    ids = c.pieces.encode(texts)
    back = [c.table.decode(x).decode("utf-8", "replace") for x in ids] if {"decoded", "decoded_sha256"} & {*wanted} else []
    for name in wanted:
        if name == "n_tokens":
            yield pa.array([len(x) for x in ids], pa.int64())
        elif name == "ids":
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
        elif name == "ids_sha256":
            yield pa.array([hashlib.sha256(",".join([c.decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in ids], pa.string())
        elif name == "decoded":
            yield pa.array(back, pa.string())
        else:
            yield pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())


def encoded(docs: DataFrame, path: str, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """doc_id and, of each whole text, the asked-for `outputs`. `path`: a byte-level BPE file in the tokenizers format,
    read on the driver and broadcast (a vocabulary of some MB, which does not grow with the data)."""
    spark: SparkSession = tune(docs.sparkSession)
    source = spark.sparkContext.broadcast(read_file(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(source.value)  # of this task: a second or so, and nothing stays in the worker
        yield from each(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), *_columns(c, [x.decode() for x in texts_of(b)], outputs)], names=["doc_id", *outputs]))

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{k} {OUTPUTS[k]}" for k in outputs)]))
