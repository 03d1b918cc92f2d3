"""Whitening against a full eigendecomposition, and its edge cases."""

import math

import numpy as np
import pytest

from kgloom.llm import whitening


def brute(vectors, components=32):
    """n, deviations, whitened rows (sign open), shares of the trace; in Python's integers up to the covariance."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    shifted = [[n * a - s for a, s in zip(row, sums)] for row in x]
    y = np.array([[a / n for a in row] for row in shifted])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [sum(a * a for a in row) for row in shifted], y @ u / np.sqrt(e), e / np.trace(v)


def check(rows, vectors, ids, components=32, within=1e-7):
    n, deviations, z, share = brute(vectors, components)
    got = {(r.vec_id, r.component): r for r in rows}
    k = z.shape[1]
    assert set(got) == {(i, c) for i in ids for c in range(1, k + 1)} and len(rows) == len(got)
    mine = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * signs - z).max() < within
    for i, dev in zip(ids, deviations):
        assert got[i, 1].n == n and got[i, 1].deviation == dev
    assert all(abs(got[ids[0], c].explained / share[c - 1] - 1) < 1e-9 for c in range(1, k + 1))
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9
    return mine


@pytest.mark.parametrize("dimensions,rows", [(64, 400), (6, 50), (150, 500)])
def test_equals_a_full_decomposition(spark, dimensions, rows):
    rng = np.random.default_rng(dimensions)
    vectors = (rng.standard_normal((rows, dimensions)) * np.geomspace(20, 1, dimensions)) @ np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
    vectors = vectors.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    mine = check(whitening.report(table).collect(), vectors, list(range(rows)))
    assert np.abs(mine.T @ mine / rows - np.eye(mine.shape[1])).max() < 1e-9


def test_lobpcg_settles_where_the_blocks_do_not_span_the_space():
    """A space far wider than iterate, residuals and directions together, with close eigenvalues: rounds are needed, and directions of before."""
    rng = np.random.default_rng(1)
    d = 600
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.concatenate([np.linspace(10, 9, 12), np.linspace(8, 1, d - 12)])
    v = (q * e) @ q.T
    made = []
    values, vectors, residual = whitening.lobpcg(lambda b: made.append(b.shape[1]) or v @ b, d, 10, 1e-12, 300)
    assert np.abs(values - e[:10]).max() < 1e-10 and residual <= 1e-12 and 3 < len(made) < 120 and max(made) <= 2 * (10 + whitening.GUARD)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: v @ b, d, 10, 1e-12, 3)


def test_unusable_rows_repeats_and_other_columns(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((30, 4)).round(3)
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(good)]
    bad = [(100, None, "a"), (101, [1.0, None, 0.0, 0.0], "b"), (102, [1.0, float("nan"), 0.0, 0.0], "c"), (103, [float("inf"), 0.0, 0.0, 0.0], "d"), (104, [1.0], "e"), (105, [], "f")]
    again = [(None, rows[0][1], "g"), (3, rows[3][1], "h")]
    table = spark.createDataFrame(rows + bad + again, "vec_id long, embedding array<double>, x string")
    got = whitening.report(table).collect()
    assert len(got) == 32 * 4 and sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 8
    first = [r for r in got if not (r.vec_id == 3)]
    vectors = [*good, good[0], good[3]]
    n, deviations, z, _ = brute(vectors)
    mine = {(r.vec_id, r.component): r for r in first}
    assert n == first[0].n and mine[0, 1].deviation == deviations[0] == mine[None, 1].deviation
    assert abs(abs(mine[5, 2].whitened) - abs(z[5, 1])) < 1e-9


def test_no_variance_no_rows_and_far_entries(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.report(same).collect() == [] and whitening.report(same.limit(0)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.report(line).collect()} == {1}
    far = spark.createDataFrame([(0, [1e30, 0.0]), (1, [0.0, 1.0]), (2, [-1e30, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.report(far).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2} and all(r.deviation is None or r.vec_id == 1 for r in rows)
