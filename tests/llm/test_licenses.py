import random

import numpy as np

from kgloom.llm import licenses


def lcs(a, b):
    """Length of the longest common subsequence, by bits (Hyyrö, "Bit-Parallel LCS-length Computation Revisited", 2004)."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    v, whole = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & whole
    return len(b) - v.bit_count()


def test_alignment_equals_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 15)).astype(np.uint64)
        b = a[rng.random(len(a)) > 0.15]
        pairs = licenses.aligned(a, b)
        assert len(pairs) == lcs(a.tolist(), b.tolist())
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_planted_notices_and_edits(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["an", "ther", "esti", "ble", "the", "of"]) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        k = rng.randrange(len(licenses.TEMPLATES))
        name, text = licenses.TEMPLATES[k]
        if i % 3 == 1:
            words = text.split()
            if len(words) > 12:
                words[len(words) // 2] = "changed"
            text = " ".join(words).upper()
        if i % 3 == 2:
            rows.append((i, filler(80)))
            continue
        before = filler(rng.randrange(40)) + "\n"
        rows.append((i, before + text + "\n" + filler(30)))
        want[i] = (name, len(before.encode()))
    rows += [(900, None), (901, ""), (902, "license the"), (None, licenses.TEMPLATES[2][1]), (903, (licenses.TEMPLATES[4][1] + " x\n") * 3)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, matches int")
    got = {r.doc_id: r.matches for r in licenses.scan(docs).collect()}
    for i, (name, start) in want.items():
        assert any(m.license == name and abs(m.start - start) <= 2 and m.coverage >= 0.9 for m in got[i]), (i, got[i])
    assert all(not got[i] for i, _ in rows if i is not None and i < 900 and i not in want)
    assert not got[900] and not got[901] and not got[902] and got[None][0].license == "MIT" and len(got[903]) == 3
    assert licenses.scan(docs.limit(0)).count() == 0


def reported(text):
    return [(m["license"], m["coverage"]) for m in licenses.scan_texts([text.encode()], licenses.Index(licenses.TEMPLATES))[0]]


def test_repeated_first_words_hide_nothing():
    for name, text in [x for x in licenses.TEMPLATES if len(x[1]) < 2500]:
        for times, size in ((10, 7), (30, 4)):
            again = " ".join([" ".join(text.split()[:size])] * times)
            assert (name, 1.0) in reported(f"{again} {text}"), (name, times)


def test_whole_texts_are_told_apart():
    for name, text in licenses.texts_of_licenses():
        assert [x for x, c in reported(f"Some words before.\n{text}\nand others after it") if c > 0.99] == [name]
        words = text.split()
        words[len(words) // 2 :: 9] = ["changed"] * len(words[len(words) // 2 :: 9])
        (found,) = reported(" ".join(words))
        assert found[0] == name and 0.9 < found[1] < 0.99
    half = dict(licenses.texts_of_licenses())["MIT"].split()
    assert not reported(" ".join(half[: len(half) // 2]) + " but all else is another text") or reported(" ".join(half[: len(half) // 2]))[0][1] < 1 or len(half) > 100


def test_against_brute_force():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    templates = [(f"t{k}", text(rng.randrange(8, 40))) for k in range(6)]
    index = licenses.Index(templates)
    for _ in range(60):
        name, base = rng.choice(templates)
        words = base.split()
        for at in rng.sample(range(len(words)), rng.randrange(1 + len(words) // 8)):
            words[at] = "changed"
        whole = f"{text(rng.randrange(30))} {' '.join(words)} {text(rng.randrange(30))}"
        got = {m["license"]: m["coverage"] for m in licenses.scan_texts([whole.encode()], index)[0]}
        hashes = licenses.Words([whole.encode()], licenses.PUNCT, lower=True).hash
        best = {n: lcs(w.tolist(), hashes.tolist()) / len(w) for (n, _), w in zip(templates, index.words)}
        assert got[name] >= 1 - words.count("changed") / len(words) - 1e-9
        assert all(best[n] >= c - 1e-9 and best[n] >= 0.8 for n, c in got.items())


SIBLINGS = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    *((f"CC-{v}-4.0", f"Licensed under CC {v.replace('-', ' ', 0)} 4.0") for v in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]


def test_siblings_are_told_apart():
    for name, text in SIBLINGS:
        assert [x for x, _ in reported(f"some words before. {text} and others after it")] == [name], text
    for other in ("Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY-NC 3.0."):
        assert reported(other) == []


def edited_texts():
    rng = random.Random(5)
    for name, text in licenses.texts_of_licenses():
        words = text.split()
        for size in (50, 250, 600):
            for at in {len(words) // 2, rng.randrange(len(words) // 4, 3 * len(words) // 4)}:
                if size <= len(words) // 3:
                    yield name, text, words[:at] + [f"new{rng.randrange(99)}" for _ in range(size)] + words[at:]
                if size <= 0.15 * len(words):
                    yield name, text, words[: at - size // 2] + words[at + size - size // 2 :]


def test_whole_texts_with_long_gaps_against_brute_force():
    """Long stretches inserted or missing: the license is found, alone, with the coverage of a longest common subsequence."""
    index, seen = licenses.Index(licenses.TEMPLATES), 0
    for name, text, words in edited_texts():
        edited = f"{'before ' * 30}{' '.join(words)}{' after' * 30}"
        (found,) = licenses.scan_texts([edited.encode()], index)[0]
        template, hashes = (licenses.Words([x.encode()], licenses.PUNCT, lower=True).hash.tolist() for x in (text, edited))
        assert found["license"] == name
        assert 0 <= lcs(template, hashes) / len(template) - found["coverage"] < 0.01
        assert found["start"] >= 200 and found["stop"] <= len(edited.encode()) - 170
        seen += 1
    assert seen > 30


def test_copies_in_one_long_text():
    text = dict(licenses.texts_of_licenses())["MIT"]
    many = "\n\n".join([text, "Licensed under CC BY 4.0."] * 60)
    assert [x for x, c in reported(many)] == ["MIT", "CC-BY-4.0"] * 60
    assert reported("word " * 300_000 + text) == [("MIT", 1.0)]
