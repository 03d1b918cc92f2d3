"""Secret scan: fixed patterns, and the sliding-window Shannon entropy of candidate strings of each character class.

A candidate of a class is a maximal run of its characters that is at least as long as its window. The entropy of every window of
every candidate comes from incremental counts: from one window to the next, one character leaves and one enters, and the sum
of count * log2(count) over the characters changes by what these two change (whole numbers in 2**-20 of a bit, so that the sum is exact).
Windows whose entropy reaches the class's limit are secret; those that overlap or touch are one span. Candidates that the allow-list
knows (plain words, UUIDs, placeholders of manuals, digests of nothing) give no entropy spans; the fixed patterns' spans stay.

The scan is one pass over the texts without a shuffle: Arrow batches of texts are one buffer for the patterns and for the entropy.
The patterns read bytes, and all that they and the classes match is ASCII, so spans are the same as over characters; places are
turned into code points at the end.

Defined results: null and empty texts have no spans; of long texts every byte is read; repeated rows are scanned each; null doc_ids
are kept as they are; extra columns are not read. A table without rows gives none.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, runs, texts_of, tidy, tune

#: Fixed values of the contract: kinds in order, their patterns (letters of the first in either case), and the least characters of a group.
PATTERNS = [
    ("assign", rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 12),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]+", 0, 16),
]
BASE = [p[0] for p in PATTERNS]


@dataclasses.dataclass(frozen=True)
class Class:
    """Characters (as a pattern's class), the window's length, and the least entropy in bits a character."""

    kind: str
    characters: str
    window: int
    bits: float


CLASSES = (Class("entropy_hex", "0-9A-Fa-f", 24, 3.0), Class("entropy_base64", "A-Za-z0-9+/=_-", 32, 4.25))

#: Patterns that make a candidate harmless; they are searched in the whole candidate.
ALLOW = (
    r"^[A-Za-z]+([/_=+-]+[A-Za-z]+)*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Yy][Oo][Uu][Rr]_?[Kk][Ee][Yy]",
    r"0123456789[Aa][Bb][Cc][Dd][Ee][Ff]|[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh][Ii][Jj][Kk][Ll][Mm]",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)

#: Sums of count * log2(count) are kept in this fraction of a bit.
UNIT = 1 << 20
SCHEMA = "array<struct<kind:string,start:long,stop:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def weights(window: int) -> np.ndarray:
    """count * log2(count) for the counts 0 .. window, in units."""
    return np.array([0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))], dtype=np.int64)


def most_weight(c: Class) -> int:
    """The greatest sum of weights that a window of the class's least entropy has; a unit a character makes up for rounding."""
    return math.floor((math.log2(c.window) - c.bits) * c.window * UNIT) + c.window


def sliding(codes: np.ndarray, window: int) -> np.ndarray:
    """The sum of weights of each window of `codes`, in order.

    A character's counts as it enters and as it leaves are differences of its ranks among its equals; the sums are running
    totals of what entering adds, less what leaving takes away."""
    n = len(codes)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    base = codes.astype(np.int64) * (n + 1)
    key = base[order] + order
    rank = np.empty(n, dtype=np.int64)
    rank[order] = at
    entering = rank - np.searchsorted(key, base + np.maximum(at - window + 1, 0)) + 1
    leaving = np.searchsorted(key, base + np.minimum(at + window, n)) - rank
    w = weights(window)
    step = w[1:] - w[:-1]
    added, taken = np.cumsum(step[entering - 1]), np.cumsum(step[leaving - 1])
    return added[window - 1 :] - np.concatenate([[0], taken[: n - window]])


def _entropy_spans(buffer: bytes, data: np.ndarray, c: Class, allow: re.Pattern | None) -> Iterator[tuple[int, int]]:
    """Spans of one class in the buffer, which no candidate crosses texts in."""
    member = np.zeros(256, dtype=bool)
    member[list(b"".join(re.findall(f"[{c.characters}]".encode(), bytes(range(256)))))] = True
    start, stop = runs(member[data])
    long = stop - start >= c.window
    found = [(a, b) for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True) if allow is None or not allow.search(buffer[a:b])]
    if not found:
        return
    sums = sliding(np.concatenate([data[a:b] for a, b in found]), c.window)
    least, o = most_weight(c), 0
    for a, b in found:
        hit = np.flatnonzero(sums[o : o + b - a - c.window + 1] <= least)
        o += b - a
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) > c.window)
            yield from zip((a + hit[np.concatenate([[0], cut + 1])]).tolist(), (a + hit[np.concatenate([cut, [len(hit) - 1]])] + c.window).tolist(), strict=True)


def spans_of(texts: list[bytes], classes: tuple[Class, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[list[dict]]:
    """For each text its spans (kind, start, stop), in code points, by start and then in the order of kinds."""
    buffer = b"\n".join(texts)
    data = np.frombuffer(buffer, dtype=np.uint8)
    found: list[tuple[int, int, int]] = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, buffer) if m.end(group) - m.start(group) >= least]
    known = re.compile("|".join(f"(?:{p})" for p in allow).encode()) if allow else None
    for k, c in enumerate(classes, len(PATTERNS)):
        found += [(a, k, b) for a, b in _entropy_spans(buffer, data, c, known)]
    out: list[list[dict]] = [[] for _ in texts]
    if not found:
        return out
    found.sort()
    names = [*BASE, *(c.kind for c in classes)]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    first = np.concatenate([[0], ends[:-1]])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    for (a, k, b), i in zip(found, np.searchsorted(ends, [a for a, _, _ in found], side="right").tolist(), strict=True):
        at = points[first[i]]
        out[i].append({"kind": names[k], "start": int(points[a] - at), "stop": int(points[b] - at)})
    return out


def scan(docs: DataFrame, classes: tuple[Class, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop): those of the fixed patterns and those of the classes."""
    tune(docs.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans_of(texts_of(b), classes, allow), type=_ARROW)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(lambda batches: each(batches, make)), f"doc_id {kind}, spans {SCHEMA}")


def written_out(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]", classes: tuple[Class, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with every byte of every span replaced: runs of overlapping or touching spans become one mark. All columns stay."""
    tune(docs.sparkSession)

    def clean(text: bytes | None, spans: list[dict]) -> str | None:
        if text is None:
            return None
        whole, out, at = text.decode("utf-8", "replace"), [], 0
        for s in sorted(spans, key=lambda s: s["start"]):
            if s["start"] > at or not out:
                out += [whole[at : s["start"]], mark]
            at = max(at, s["stop"])
        return "".join([*out, whole[at:]])

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column("text").cast(pa.binary()).to_pylist()
        new = [clean(t, s) for t, s in zip(raw, spans_of([t or b"" for t in raw], classes, allow), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(new, type=f.type) if f.name == "text" else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)

    return docs.mapInArrow(tidy(lambda batches: each(batches, make)), docs.schema)


def oracle() -> str:
    """The SQL of `report`, with the same patterns, limits and allow-list."""
    either = {"assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"}
    patterns = [(kind, either.get(kind, p.decode()), group, least) for kind, p, group, least in PATTERNS]
    patterns += [(c.kind, f"[{c.characters}]{{{c.window},}}", 0, c.window) for c in CLASSES]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS parts, {least} AS least FROM d"
        for k, (kind, p, group, least) in enumerate(patterns)
    )
    known = " OR ".join(f"regexp_matches(s, '{p}')" for p in ALLOW)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
placed AS (SELECT doc_id, k, kind, m[i] AS s, least, length(v[i]) AS n, CAST(list_sum([length(x) FOR x IN parts[:i]]) + coalesce(list_sum([length(x) FOR x IN m[:i - 1]]), 0) AS BIGINT) AS a
       FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
base AS (SELECT doc_id, k, kind, a, a + length(s) AS b FROM placed WHERE k < {len(BASE)} AND n >= least),
c AS (SELECT doc_id, k, kind, a, s, least AS w FROM placed WHERE k >= {len(BASE)} AND NOT ({known})),
win AS (SELECT doc_id, k, kind, a, w, i, substr(s, i, w) AS x FROM (SELECT *, unnest(range(1, length(s) - w + 2)) AS i FROM c)),
chars AS (SELECT doc_id, k, kind, a, w, i, ch, count(*) AS n FROM (SELECT *, unnest(string_split(x, '')) AS ch FROM win) GROUP BY ALL),
hit AS (SELECT doc_id, k, kind, a, w, a + i - 1 AS p FROM chars GROUP BY doc_id, k, kind, a, w, i
        HAVING sum(CAST(round(n * log2(n) * {UNIT}) AS BIGINT)) <= CASE k {" ".join(f"WHEN {k} THEN {most_weight(c)}" for k, c in enumerate(CLASSES, len(BASE)))} END),
isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k, a ORDER BY p) AS g FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, k, a ORDER BY p) <= w THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, k, kind, min(p), max(p) + any_value(w) FROM isl GROUP BY doc_id, k, kind, a, g),
r AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""
