"""Rank correlations by block products against pandas."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.primitives import melt, written
from plumbline.operators import binning, rank_matrix, screening


def nearest(d, xs, ys, fill):
    d = d.fillna(fill) if fill is not None else d
    r = d.rank()
    out = {}
    for x in xs:
        best = None
        for y in ys:
            both = r[[x, y]].dropna() if x != y else None
            if x == y or both[x].std() == 0 or both[y].std() == 0 or len(both) < 2:
                continue
            hit = (round(abs(float(np.corrcoef(both[x], both[y])[0, 1])), 9), y)
            best = max(best, hit) if best else hit
        if best:
            out[x] = best
    return out


@pytest.mark.parametrize("fill", [0.0, None])
@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, monkeypatch, fill, small):
    if small:  # several groups a column, blocks of few rows, tiles of one pair
        monkeypatch.setattr(rank_matrix, "GROUP_VALUES", 300)
        monkeypatch.setattr(rank_matrix, "BLOCK_CELLS", 1)
        monkeypatch.setattr(rank_matrix, "TILE", 1)
    rng, n = np.random.default_rng(0), 4000
    a = rng.normal(size=n)
    d = pd.DataFrame({"a": a, "b": np.exp(a) + rng.normal(size=n) * 0.1, "few": rng.integers(0, 4, n).astype(float), "zeros": np.where(rng.random(n) < 0.6, 0.0, a), "flat": np.ones(n), "copy": a, "down": -(a**3), "none": np.full(n, np.nan)})
    d.loc[rng.random(n) < 0.2, "b"] = np.nan
    d.loc[rng.random(n) < 0.3, "few"] = np.nan
    table = spark.createDataFrame(d).repartition(5).cache()
    xs, ys = ["a", "b", "few", "zeros", "flat", "none"], ["a", "b", "copy", "down", "few", "flat"]
    got = {r.feature: (r["corr"], r.nearest) for r in rank_matrix.nearest_ranked(table, xs, ys, fill).collect()}
    want = nearest(d, xs, ys, fill)
    assert got.keys() == want.keys()
    for f in want:
        assert got[f][0] == pytest.approx(want[f][0], abs=2e-9) and (got[f][1] == want[f][1] or {got[f][1], want[f][1]} <= {"copy", "down"}), f
    assert rank_matrix.nearest_ranked(table.limit(0), xs, ys, fill).count() == 0


def test_many_columns(spark):
    """2,000 columns against 400: the plan does not grow with the pairs."""
    n, wide_ = 300, 2000
    rows = spark.range(n, numPartitions=2).selectExpr(*[f"cast((id * {2 * k + 3} + {k}) % 8009 as double) AS v{k}" for k in range(wide_)])
    table = written(rows, "many")
    xs, ys = [f"v{k}" for k in range(wide_)], [f"v{k}" for k in range(0, 2000, 5)]
    got = {r.feature: r for r in screening.redundancy(table, xs, ys).collect()}
    ids = np.arange(n)
    ranks = np.argsort(np.argsort((ids[None] * (2 * np.arange(wide_)[:, None] + 3) + np.arange(wide_)[:, None]) % 8009, 1), 1).astype(float)
    corr = np.round(np.abs(np.corrcoef(ranks)[:, ::5]), 9)
    corr[np.arange(0, 2000, 5), np.arange(400)] = -1
    assert len(got) == wide_ and np.allclose([got[f]["corr"] for f in xs], corr.max(1), atol=2e-9)
    assert got["v0"].redundant == (corr[0].max() > 0.9) and table.select(F.count("*")).first()[0] == n


def test_target_spearman_is_that_of_the_long_form(spark, monkeypatch):
    monkeypatch.setattr(rank_matrix, "GROUP_VALUES", 50)
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.normal()) if k % 4 else None, float(rng.integers(0, 5)), 1.0, 2.0 if k < 5 else None, None, float(rng.integers(0, 40)) if k % 9 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double").repartition(3)
    features = ["a", "b", "c", "d", "e"]
    got = {r.feature: (r.n, r.spearman) for r in rank_matrix.target_spearman(df, features, "y").collect()}
    want = {r.feature: (r.n, r.spearman) for r in binning.target_spearman(melt(df, features, ["y"]), "y").collect()}
    assert got.keys() == want.keys() == {"a", "b", "c", "d"} and got["c"][1] is got["d"][1] is None
    assert all(got[f][0] == want[f][0] and got[f][1] == pytest.approx(want[f][1], abs=1e-9) for f in got)


def test_blocks_hold_what_is_there_in_small_rows(spark, monkeypatch):
    """A row of a block is no longer than its values and places, however long the table is, and few rows are read at a time."""
    monkeypatch.setattr(rank_matrix, "BLOCK_ROWS", 256)
    monkeypatch.setattr(rank_matrix, "BATCH_BYTES", 12 * 256 * 16)
    df = spark.range(6000, numPartitions=2).selectExpr("cast((id * 7919) % 6007 AS double) AS a", "CASE WHEN id % 10 = 0 THEN 1.0D END AS b")
    ranks, held = rank_matrix.ranked_blocks(df, {"a": "a", "b": "b"})
    size = held[0].selectExpr("sum(coalesce(length(ranks), 0) + coalesce(length(values), 0) + length(places)) AS whole", "max(length(places)) AS most", "max(size) AS size").first()
    assert size.whole == 12 * (6000 + 600) and size.most <= 4 * 256 and size.size == 256
    with rank_matrix._few(spark, 2):
        counts = ranks.repartition(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["rows"]) for b in batches), "rows long").collect()
    assert len(counts) > 1 and max(r.rows for r in counts) <= 16
