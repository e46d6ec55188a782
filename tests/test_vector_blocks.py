"""All pairs of vectors in tasks of two blocks, from which no pair leaves."""

import numpy as np
import pytest

from seqspark.operators import vectors


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(4)
    x = random.normal(size=(700, 6)).round(2)
    x[40:60] = x[:20]  # equal vectors under other keys
    return x


@pytest.mark.parametrize(("exponent", "shift"), [(2, 0.0), (0.5, 0.0), (2, 1e6)])
def test_density_weights_of_many_blocks(spark, rows, monkeypatch, exponent, shift):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100 * 6 * 8)
    monkeypatch.setattr(vectors, "within", None)  # no pair is written
    x = rows + shift
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)] + [("k1", x[1].tolist()), ("nan", [float("nan")] * 6), ("null", None)], "key string, v array<double>")
    got = {r["key"]: r["weight"] for r in vectors.density_weights(df, "key", "v", 0.8, exponent).distinct().collect()}
    x = np.concatenate([x, x[1:2]])
    names = np.array([f"k{i}" for i in range(700)] + ["k1"])
    d = ((x[:, None] - x[None]) ** 2).mean(2)
    part = np.where((d < 0.8) & (names[:, None] != names[None]), np.maximum(1 - d / 0.8, 0) ** exponent, 0).sum(1)
    want = {str(n): 1 / (1 + part[names == n].sum()) for n in np.unique(names)} | {"nan": 1.0}
    assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("metric", ["euclid", "cityblock", "correlation"])
def test_linkage_of_many_blocks(spark, rows, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100 * 6 * 8)
    monkeypatch.setattr(vectors, "STEP", 64)
    label = np.array([["one", "two", "three", "four"][i % 7 % 4] for i in range(700)])
    label[5] = "alone"
    df = spark.createDataFrame([(str(n), v.tolist()) for n, v in zip(label, rows, strict=True)] + [(None, [0.0] * 6), ("five", None)], "label string, v array<double>")
    d = vectors._pairwise(rows, rows, metric)
    got = {(r["a"], r["b"]): (r["smallest"], r["largest"], r["average"]) for r in vectors.linkage(df, "label", "v", metric).collect()}
    names = sorted(set(label.tolist()))
    want = {(p, q): d[label == p][:, label == q] for p in names for q in names if p < q}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert got[k] == pytest.approx((m.min(), m.max(), m.mean()), abs=1e-9)
