"""Scans of many columns against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import wide
from plumbline.functions.primitives import written
from plumbline.operators import binning, drift, profile

AT = [k / 10 for k in range(11)] + [0.01, 0.99, 0.25, 0.755]


@pytest.fixture(scope="module")
def frame():
    rng, n = np.random.default_rng(0), 40_000
    d = pd.DataFrame({
        "normal": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float), "heavy": np.exp(rng.normal(size=n) * 8), "zero": np.zeros(n), "mixed": np.where(rng.random(n) < 0.4, 0, rng.random(n)),
        "tiny": -rng.random(n) * 1e-300, "none": np.full(n, np.nan), "signs": np.where(rng.random(n) < 0.5, 0.0, -0.0), "huge": np.where(rng.random(n) < 0.01, 1e308, rng.random(n)),
    })
    d.loc[rng.random(n) < 0.1, "normal"] = np.nan
    return d.assign(k=rng.integers(0, 2, n), split=np.where(rng.random(n) < 0.6, "train", np.where(rng.random(n) < 0.5, "oot", "test")), label=rng.integers(0, 2, n))


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(5).cache()


COLUMNS = ["normal", "few", "heavy", "zero", "mixed", "tiny", "none", "signs"]


@pytest.mark.parametrize("rest", [4096, 30])
def test_moments_and_quantiles(frame, table, rest, monkeypatch):
    monkeypatch.setattr(wide, "REST", rest)  # few values left: more scans before the last
    about = wide.moments(table, COLUMNS)
    found = wide.quantiles(table, COLUMNS, AT, about)
    for c in COLUMNS:
        v, m = frame[c].dropna().to_numpy(), about[c]
        assert m["rows"] == len(frame) and m["n"] == len(v)
        if not len(v):
            assert found[c] is None and m["mean"] is None
            continue
        assert m["min"] == v.min() and m["max"] == v.max() and m["mean"] == pytest.approx(v.mean(), rel=1e-12) and m["m2"] == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-9)
        assert np.allclose(found[c], np.quantile(v, AT), rtol=1e-14, atol=0), c


def test_outer_values(frame, table):
    assert wide.quantiles(table, ["huge"], [0, 0.5, 1])["huge"] == [frame.huge.min(), pytest.approx(frame.huge.median()), 1e308]


def test_counts_by_borders_and_values(frame, table):
    borders = {"normal": [-1.0, 0.0, 1.0], "few": [1.0], "mixed": [0.0, 0.5]}
    for r in wide.border_counts(table, list(borders), borders, F.col("k"), 2).collect():
        v, b, want = frame[frame.k == r["class"]][r.feature], borders[r.feature], []
        for j in range(len(b) + 1):
            low, high = b[j - 1] if j else -np.inf, b[j] if j < len(b) else np.inf
            want += [((v > low) & (v < high)).sum(), *([(v == high).sum()] if j < len(b) else [])]
        assert r.codes[: len(want)] == want and r.missing == v.isna().sum()
    counts = wide.border_counts(table, ["few"], {"few": [1.0]})
    assert {(r.bin): r.n for r in wide.bin_counts(counts).collect()} == {0: (frame.few <= 1).sum(), 1: (frame.few > 1).sum()}
    assert {(r.bin): r.n for r in wide.bin_counts(counts, "left").collect()} == {0: (frame.few < 1).sum(), 1: (frame.few >= 1).sum()}


def test_distinct_in_parts(frame, table, monkeypatch):
    monkeypatch.setattr(wide, "GROUP_VALUES", 3000)
    monkeypatch.setattr(wide, "HELD_BYTES", 100_000)
    got = {r.feature: r for r in profile.distinct_values(table, COLUMNS, len(frame)).collect()}
    assert {f: (r.distinct, r.top) for f, r in got.items()} == {c: (frame[c].nunique(), frame[c].value_counts().iloc[0]) for c in COLUMNS if c != "none"}


def test_empty_table(table):
    empty = table.limit(0)
    assert wide.quantiles(empty, ["normal"], [0.5]) == {"normal": None}
    assert {r.feature: r.n for r in profile.basic_stats(empty, ["normal", "few"]).collect()} == {"normal": 0, "few": 0}
    assert binning.iv_table(empty, ["normal"]).count() == 0 and drift.psi_numeric(empty, ["normal"]).count() == 0
    assert drift.psi_signed(empty, ["normal"]).count() == 0 and drift.feature_report(empty, ["normal"]).count() == 1


def test_signed_psi(frame, table):
    got = {r.feature: r.psi for r in drift.psi_signed(table, ["normal", "mixed", "signs"]).collect()}
    for c in got:
        base, other = frame[frame.split == "train"][c], frame[frame.split == "oot"][c]
        edges = np.unique(np.round(np.quantile(base[base > 0], [k / 10 for k in range(11)]), 9))[1:-1] if (base > 0).any() else np.empty(0)
        name = lambda v: np.where(v.isna(), "m", np.where(v < 0, "n", np.where(v == 0, "z", np.searchsorted(edges, v).astype(str))))
        a, b = pd.Series(name(base)).value_counts(normalize=True), pd.Series(name(other)).value_counts(normalize=True)
        p, q = a.align(b, fill_value=0)
        p, q = p + 1e-6, q + 1e-6
        assert got[c] == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=1e-9)


def test_fifteen_hundred_columns(spark):
    """No row for each cell: what moves are sums of each task and column."""
    n, width = 1500, 1500
    rows = spark.range(n, numPartitions=3).selectExpr("cast(id % 2 AS int) AS label", *[f"(id * {2 * k + 1}) % 1009 / {k + 1}.0D AS v{k}" for k in range(width)])
    wide_rows = written(rows, "wide")
    names = [f"v{k}" for k in range(width)]
    values = {k: np.array([(i * (2 * k + 1)) % 1009 / (k + 1.0) for i in range(n)]) for k in (0, 7, 1499)}
    edges = binning.equal_freq_edges(wide_rows, names)
    for k, v in values.items():
        assert np.allclose(edges[f"v{k}"], np.unique(np.round(np.quantile(v, [j / 10 for j in range(11)]), 9)))
    counts = wide.border_counts(wide_rows, names, {f: wide.inner(e) for f, e in edges.items()}, F.col("label"), 2)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert counts.count() == 2 * width
    iv = {r.feature: r.iv for r in binning.iv_table(wide_rows, ["v0", "v7", "v1499"]).collect()}
    assert len(iv) == 3 and all(x >= 0 for x in iv.values())


def test_distinct_values_come_in_small_groups(spark, tmp_path):
    """No group of distinct values grows with the table, and values that come again in a task are added up before they gather."""
    spark.range(0, 2_500_000, 1, 2).selectExpr("CAST(id * 7919 % 2500000 AS DOUBLE) AS x", "CAST(id % 10 AS DOUBLE) AS y").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    got = wide.value_counts(rows, ["x", "y"], lambda v, n: {"distinct": len(v), "n": int(n.sum())}, "distinct long, n long", 2_500_000).collect()
    for f, distinct in (("x", 2_500_000), ("y", 10)):
        assert sum(r.distinct for r in got if r.feature == f) == distinct and sum(r.n for r in got if r.feature == f) == 2_500_000
    assert max(r.distinct for r in got) < 1_200_000
