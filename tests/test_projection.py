"""Components by explained variance, against numpy's singular values."""

import numpy as np
import pytest

from tessera.operators import clustering as C
from tessera.operators.projection import components, folded


def decaying(n, d, seed=1, rate=0.7):
    r = np.random.default_rng(seed)
    axes = np.linalg.qr(r.normal(size=(d, d)))[0]
    return (r.normal(size=(n, d)) * rate ** np.arange(d)) @ axes.T * 5 + r.normal(size=d)


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(-1, None)], "vec_id long, embedding array<double>").repartition(parts)


def wanted(x):
    s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    return s**2 / len(x), axes


def test_folding_rows_in_any_order():
    x = np.random.default_rng(0).normal(size=(50, 4))
    r = folded(folded(None, x[30:]), x[:30])
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x)[1])


@pytest.mark.parametrize("share_of", [0.85, 0.95, 0.99999])
def test_the_fewest_components_for_a_share(spark, share_of):
    x = decaying(300, 60)
    variances, axes = wanted(x)
    k = int(np.searchsorted(np.cumsum(variances) / variances.sum(), share_of)) + 1
    got = components(frame(spark, x), share_of, block=16)  # the last share needs a wider block
    assert len(got.variances) == k and got.n == 300 and got.total == pytest.approx(variances.sum(), rel=1e-9)
    assert np.allclose(got.variances, variances[:k], rtol=1e-6) and np.allclose(np.abs((got.axes * axes[:k]).sum(1)), 1, atol=1e-6)
    assert np.allclose(got.axes @ got.axes.T, np.eye(k), atol=1e-9) and got.ratios.sum() >= share_of - 1e-9


def test_a_fixed_number_of_components(spark):
    x = decaying(200, 40)
    got = components(frame(spark, x), 1.0, most=5)
    assert np.allclose(got.variances, wanted(x)[0][:5], rtol=1e-6)


def test_all_components_need_one_pass(spark):
    x = np.random.default_rng(2).normal(size=(100, 12))  # nothing stands out
    got = components(frame(spark, x), 1.0)
    assert np.allclose(got.variances, wanted(x)[0], rtol=1e-9)


def test_projection_of_rows(spark):
    x = decaying(120, 30)
    rows = frame(spark, x)
    got = components(rows, 0.95, block=16)
    out = {r.vec_id: r.embedding for r in got.project(rows, centred=True).collect()}
    assert out.pop(-1) is None and len(out) == 120
    assert np.allclose(np.array([out[i] for i in range(120)]), (x - x.mean(0)) @ got.axes.T, atol=1e-9)


def test_few_rows_constant_rows_and_none(spark):
    few = components(frame(spark, decaying(3, 20)), 1.0 - 1e-9)
    assert len(few.variances) == 2 and few.ratios.sum() == pytest.approx(1)
    assert len(components(frame(spark, np.ones((8, 5))), 0.9).variances) == 0
    empty = components(frame(spark, np.zeros((0, 5))), 0.9)
    assert empty.n == 0 and len(empty.axes) == 0


def test_wide_rows_of_a_level(spark, monkeypatch):
    x = decaying(150, 120)
    rows, explained, axes = C.projected_with_axes(frame(spark, x).where("vec_id >= 0"), share_of=0.9)
    assert explained >= 0.9 and len(axes) < 10 and len(rows.first().embedding) == len(axes)
    plain = C.projected_with_axes(frame(spark, x).where("vec_id >= 0"), most=4)
    monkeypatch.setattr(C, "WIDE", 100)
    wide = C.projected_with_axes(frame(spark, x).where("vec_id >= 0"), most=4)
    assert wide[1] == pytest.approx(plain[1], abs=1e-6) and np.allclose(np.abs((wide[2] * plain[2]).sum(1)), 1, atol=1e-6)
