"""Whitening against a full eigendecomposition."""

import numpy as np
import pytest

from netweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS component", "3 AS n")


def plain(vectors, most=8):
    kept = [(i, v) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    c = (n * x - s).astype(float) / n
    values, unit = np.linalg.eigh(c.T @ c / n)
    values, unit = values[::-1][:most], unit[:, ::-1][:, :most]
    return [i for i, _ in kept], n, [int(d) for d in ((n * x - s) ** 2).sum(1)], c @ unit / np.sqrt(values), values / (c * c).sum() * n


def close(found, vectors, tolerance=1e-9):
    ids, n, deviation, white, share = plain(vectors)
    most = white.shape[1]
    assert len(found) == len(ids) * most
    at = {i: k for k, i in enumerate(ids)}
    got = np.zeros_like(white)
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == deviation[at[r.vec_id]]
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < tolerance * max(1, np.abs(white).max())


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    close(whitening.whiten(df).collect(), [(r.vec_id, list(r.embedding)) for r in df.collect()])


@pytest.mark.parametrize("dim, decay", [(64, 0.3), (64, 1.0), (20, 0.9), (5, 0.8), (16, 0.7)])
def test_fast_and_slow_decay(spark, dim, decay):
    rng = np.random.default_rng(dim)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    spread = 50 * decay ** np.arange(dim) + 0.01 * np.arange(dim)[::-1]
    v = [(i, list(row)) for i, row in enumerate(rng.standard_normal((400, dim)) * spread @ turn)]
    close(whitening.whiten(table(spark, v), **({} if dim > 5 else {"components": 5})).collect(), v, 1e-7)


def test_fast_decay_needs_no_full_dimension():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    cov, seen = turn * 0.02 ** np.minimum(np.arange(200), 9) @ turn.T, []

    def times(block):
        seen.append(block.shape[1])
        return cov @ block

    values, unit = whitening.leading(times, 200, 3)
    assert max(seen) == 11 and len(seen) <= whitening.PASSES
    assert np.allclose(values, 0.02 ** np.arange(3), rtol=1e-10) and np.allclose(np.abs((turn[:, :3] * unit).sum(0)), 1)
    flat = turn * np.linspace(1, 0.9, 200) @ turn.T
    seen.clear()
    values, _ = whitening.leading(lambda b: seen.append(b.shape[1]) or flat @ b, 200, 3)
    assert seen[-1] == 200 and np.allclose(values, np.linspace(1, 0.9, 200)[:3], rtol=1e-12)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, list(rng.standard_normal(12))) for i in range(60)]
    same = [(None, good[0][1]), (7, good[0][1]), (7, good[0][1])] * 20
    bad = [(100, None), (101, []), (102, [None] * 12), (103, [float("nan")] + [0.0] * 11), (104, [float("inf")] + [0.0] * 11), (105, [0.0] * 11 + [float("-inf")])]
    found = whitening.whiten(table(spark, good + same + bad)).collect()
    assert len(found) == 8 * (len(good) + len(same)) and {r.n for r in found} == {len(good) + len(same)}
    assert sum(r.vec_id is None for r in found) == 8 * 20 and not {r.vec_id for r in found} & set(range(100, 106))
    close(whitening.whiten(table(spark, good + bad)).collect(), good)


def test_no_variance_and_no_rows(spark):
    flat = whitening.whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(flat) == 15 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(0.0, 0.0, 0, 0.0)}
    assert whitening.whiten(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_squares_beyond_64_bits():
    d = np.array([[3_000_000_000, 2], [5, 7], [-(1 << 40), 1 << 41]], np.int64)
    high, low = whitening.exact_squares(d)
    assert [int(a) * 2**32 + int(b) for a, b in zip(high, low)] == [sum(int(x) ** 2 for x in row) for row in d]
