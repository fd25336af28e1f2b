"""Whitening against a dense eigendecomposition, and the eigensolver on hard spectra."""

import math
import random

import numpy as np
import pytest

from tracewell.llm import registry, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, n string, ids string, data string"


def plain(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = values[:k] > 1e-12 * values.sum()
    values, axes = values[:k][kept], axes[:, :k][:, kept]
    return [int(((n * r - sums) ** 2).sum()) for r in x], centred @ (axes / np.sqrt(values)), values / np.trace(centred.T @ centred / n)


def same(got, vectors, ids):
    deviation, scores, explained = plain(vectors)
    k = scores.shape[1]
    assert len(got) == len(vectors) * k
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    turn = np.sign([sum(by_id[i][c + 1].whitened * scores[row, c] for row, i in enumerate(ids)) for c in range(k)])
    for row, i in enumerate(ids):
        for c in range(k):
            r = by_id[i][c + 1]
            assert (r.n, r.deviation) == (len(vectors), deviation[row])
            assert abs(r.whitened * turn[c] - scores[row, c]) < 1e-8
            assert abs(r.explained - explained[c]) < 1e-10 * explained[c] and r.identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = registry.QUERIES["op11_whitened_embeddings"](spark, DATA).collect()
    same(got, [r.embedding for r in rows], [r.vec_id for r in rows])


def test_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 200)
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, 1 + d))) for d in range(5)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [2.0 ** 50] * 5)]
    got = whitening.whitened(frame(spark, rows + odd)).collect()
    same(got, [v for _, v in rows], [i for i, _ in rows])
    assert {r.component for r in got} == {1, 2, 3, 4, 5}


def test_copies_and_null_ids(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(20)]
    rows = [(i, [*v, 2 * v[0]]) for i, v in rows] * 2 + [(None, [0.25, 0.25, 0.25, 0.5])] * 3
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 43 * 3 and {r.n for r in got} == {43} and max(r.identity_error for r in got) < 1e-9
    assert len([r for r in got if r.vec_id is None]) == 9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(frame(spark, rows))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whitened(frame(spark, [(i, [float(i) * 1e9, 1.0]) for i in range(4)])).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 4


SPECTRA = {
    "steep": [1e9, 1e6, 1e3, 5, 4, 3, 2, 1.5, 1.2, 1.1] + [1] * 90, "flat": [1.0] * 70, "slow": list(np.linspace(1, 1.2, 150)),
    "power": list(1 / np.arange(1, 200.0) ** 2), "rank three": [3.0, 2, 1] + [0] * 60, "pairs": [5.0, 5, 4, 4, 3, 3, 2, 2, 2, 2] + [1] * 50, "zero": [0.0] * 50,
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("guards, most", [(24, 240), (2, 20)])
def test_eigensolver(monkeypatch, name, guards, most):
    """The block grows where the passes allowed are too few."""
    monkeypatch.setattr(whitening, "GUARDS", guards)
    monkeypatch.setattr(whitening, "MOST_PASSES", most)
    spectrum = np.sort(SPECTRA[name])[::-1]
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(len(spectrum),) * 2))[0]
    matrix = (turn * spectrum) @ turn.T
    values, axes = whitening.leading(lambda block: matrix @ block, len(spectrum), 8)
    scale = max(spectrum[0], 1e-300)
    assert np.abs(values - spectrum[:8]).max() <= 1e-12 * scale
    assert np.linalg.norm(matrix @ axes - axes * values, axis=0).max() <= 1e-11 * scale
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
