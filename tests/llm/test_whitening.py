"""Whitening against numpy."""

import numpy as np
import pytest

from ledgerspark.llm import whitening


@pytest.mark.parametrize("kind", ["full", "low rank", "repeated", "diagonal", "zero", "graded"])
def test_eigen(kind):
    g = np.random.default_rng(3)
    n = 24
    a = g.normal(size=(n, 3 * n if kind != "low rank" else 5))
    a = a @ a.T
    if kind == "repeated":
        q, _ = np.linalg.qr(a)
        a = q @ np.diag(np.repeat([5.0, 2.0, 1.0], 8)) @ q.T
        a = (a + a.T) / 2
    if kind == "diagonal":
        a = np.diag(np.arange(n, dtype=float))
    if kind == "zero":
        a = np.zeros((n, n))
    if kind == "graded":
        s = np.geomspace(1, 1e-6, n)
        a = a * np.outer(s, s)
    values, axes = whitening.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, abs(values[0])))
    assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-13
    assert np.abs(a @ axes - axes * values).max() < 1e-12 * max(1, abs(values[0]))


def test_eigen_of_small_matrices():
    assert whitening.eigen(np.array([[4.0]]))[0].tolist() == [4.0]
    values, axes = whitening.eigen(np.array([[2.0, 1.0], [1.0, 2.0]]))
    assert np.allclose(values, [3, 1]) and np.allclose(np.abs(axes), np.sqrt(0.5))


def test_merge_equals_one_pass():
    g = np.random.default_rng(1)
    x = g.integers(900_000, 1_100_000, (500, 7))
    parts = []
    for part in (x[:1], x[1:120], x[120:120], x[120:]):
        m = whitening.Moments.none(7)
        m.total += part.sum(0)
        m.add(part.astype(float))
        parts.append(m.pack())
    got = whitening.merged(parts, 7)
    assert got.n == 500 and (got.total == x.sum(0)).all()
    assert np.allclose(got.covariance, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-3)


def plain(rows, k=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    return [i for i, _ in good], n, deviation, (x - s / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def rows(n, width, seed=0):
    g = np.random.default_rng(seed)
    return [(i, (g.normal(size=width) * np.linspace(1, 3, width)).tolist()) for i in range(n)]


def test_whiten(spark):
    data = rows(300, 20)
    data += [(1000, data[0][1]), (0, data[1][1]), (None, data[2][1]), (1001, None), (1002, []), (1003, [float("nan")] + [0.0] * 19), (1004, [float("inf")] + [0.0] * 19), (1005, [None] + [0.0] * 19), (1006, [0.0] * 20)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in data], "vec_id bigint, embedding array<float>, x string, component int").repartition(3)
    got = whitening.whiten(df).toPandas()
    ids, n, deviation, white, explained = plain(data)
    assert len(got) == 16 * len(ids) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    want = sorted((-1 if i is None else i, d) for i, d in zip(ids, deviation, strict=True))
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id.fillna(-1).astype(int), first.deviation.astype(int), strict=True)) == want
    for k in range(16):
        own = got[(got.component == k + 1) & (got.vec_id >= 1)].set_index("vec_id").whitened
        theirs = {i: w[k] for i, w in zip(ids, white, strict=True)}
        pair = np.array([(own[i], theirs[i]) for i in own.index])
        assert min(np.abs(pair[:, 0] - pair[:, 1]).max(), np.abs(pair[:, 0] + pair[:, 1]).max()) < 1e-7
        assert abs(got[got.component == k + 1].explained.iloc[0] - explained[k]) < 1e-9


def test_few_vectors_and_huge_entries(spark):
    kind = "vec_id bigint, embedding array<double>"
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 5.0]), (3, [1.0, 2.0, 5.0]), (9, [1.0])], kind)).collect()
    assert len(got) == 9 and {r.n for r in got} == {2}  # the vector of another length is left out
    assert {round(abs(r.whitened), 9) for r in got if r.component == 1} == {1.0}
    assert all(r.whitened is None for r in got if r.component > 1) and {r.explained for r in got if r.component == 1} == {1.0}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, None)] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], kind)).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0


def test_query(spark, sf):
    got = whitening.query(spark, sf).toPandas()
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, white, _ = plain(data)
    assert len(got) == 16 * len(ids) and got.n.iloc[0] == n and got.identity_error.max() < 1e-4
    assert got[got.component == 1].set_index("vec_id").deviation.to_dict() == dict(zip(ids, deviation, strict=True))
