"""Every replicate of every metric against weighted numpy."""

import numpy as np
import pytest

from plumbline.operators import resampling
from plumbline.operators.comparison import bootstrap_auc, draws

R = 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 3000
    label = rng.integers(0, 2, n)
    score = np.where(rng.random(n) < 0.5, 0.25, np.round(rng.random(n) * 0.6 + 0.3 * label, 2))  # half of the rows have one score, over several parts
    rows = [(i, int(label[i]), float(score[i]), int(rng.integers(0, 2)), float(rng.normal())) for i in range(n)]
    table = spark.createDataFrame(rows + [(n, None, 0.5, 1, 1.0), (n + 1, 1, None, 0, 1.0)], "id long, label int, score double, arm int, y double").repartition(6).cache()
    return table, np.array([r[1:] for r in rows]), draws(np.arange(n), R, 7)


def test_ordered_metrics(data):
    table, x, w = data
    label, score = x[:, 0], x[:, 1]
    got = {r.replicate: r for r in resampling.bootstrap_ordered(table, "label", "score", "id", R).collect()}
    old = {r.replicate: r.auc for r in bootstrap_auc(table, "label", ["score"], "id", R, 7).collect()}
    assert len(got) == R
    for k, r in got.items():
        values, at = np.unique(-score, return_inverse=True)
        pos, neg = (np.bincount(at, w[:, k] * side, len(values)) for side in (label, 1 - label))
        p, n = np.cumsum(pos), np.cumsum(neg)
        assert r.ks == pytest.approx(np.abs(p / p[-1] - n / n[-1]).max())
        assert r.pr_auc == pytest.approx((pos * p / np.maximum(p + n, 1)).sum() / p[-1])
        assert r.auc == pytest.approx((pos * (n[-1] - n + neg / 2)).sum() / (p[-1] * n[-1])) == pytest.approx(old[k])


def test_uplift_areas(data):
    table, x, w = data
    order = np.lexsort((np.arange(len(x)), -x[:, 1]))
    got = {r.replicate: r for r in resampling.bootstrap_uplift(table.filter("label is not null"), "score", "arm", "y", "id", R).collect()}
    arm, y = x[order, 2], x[order, 3]
    for k, r in got.items():
        v = w[order, k]
        yt, yc, nt, nc = (np.cumsum(v * c) for c in (arm * y, (1 - arm) * y, arm, 1 - arm))
        g = yt - np.where(nc > 0, yc * nt / np.maximum(nc, 1), 0)
        area = (v * (g + np.append(0, g[:-1])) / 2).sum() / v.sum()
        assert r.auuc == pytest.approx(area) and r.qini == pytest.approx(area - g[-1] / 2)


@pytest.mark.parametrize("metric", ["logloss", "brier", "mse", "rmse", "mae"])
def test_losses(data, metric):
    table, x, w = data
    y, s = x[:, 0], x[:, 1]
    p = np.clip(s, 1e-15, 1 - 1e-15)
    loss = {"logloss": -np.where(y == 1, np.log(p), np.log(1 - p)), "mae": np.abs(s - y)}.get(metric, (s - y) ** 2)
    for r in resampling.bootstrap_metric(table, metric, "label", "score", "id", R).collect():
        mean = (w[:, r.replicate] * loss).sum() / w[:, r.replicate].sum()
        assert r.value == pytest.approx(np.sqrt(mean) if metric == "rmse" else mean)


def test_one_class_and_empty(data):
    table = data[0]
    assert {r.ks for r in resampling.bootstrap_ordered(table.filter("label = 1"), "label", "score", "id", 3).collect()} == {None}
    assert {r.auuc for r in resampling.bootstrap_uplift(table.filter("arm = 1"), "score", "arm", "y", "id", 3).collect()} == {None}
    assert resampling.metric_interval(table.limit(0), "ks", "label", "score", "id", 3).first()["replicates"] == 0
    assert resampling.metric_change(table, "ks", "label", "score", "score", "id", 5).first()["mean"] == 0
