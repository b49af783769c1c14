"""Heavy keys, hash borders, monotone bins, permutations and perfect uplift against brute force."""

import hashlib
import itertools
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import skew
from plumbline.operators import binning, models, text, uplift


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_key_is_dealt(spark, how):
    """One key has half of the rows: the largest task joins under twice the median's."""
    rows = spark.range(40_000, numPartitions=4).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 97 = 1 THEN NULL ELSE concat('k', id % 5003) END AS k", "id")
    values = rows.filter("k IS NOT NULL AND k <> 'k1'").select("k").distinct().withColumn("v", F.length("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew.skewed_join(rows, values, ["k"], how)
        want = rows.join(values, "k", how)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=str) == sorted(map(tuple, want.select("k", "id", "v").collect()), key=str)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 2 * statistics.median(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError):
        skew.skewed_join(rows, values, ["k"], "full")
    assert skew.skewed_join(rows.limit(0), values, ["k"], how).count() == 0


def test_hot_text_is_encoded_once(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN NULL ELSE concat('t', id % 50) END AS t")
    got = {r.id: r.vector[0] for r in text.encode_distinct(rows, "t", lambda s: s.str.len().to_numpy().reshape(-1, 1).astype("float32")).collect()}
    assert got == {i: 0 if i % 3 else len(f"t{i % 50}") for i in range(3000)}


@pytest.mark.parametrize("k", [1, 7, 400, 5000])
def test_smallest_by_hash(spark, k):
    rows = spark.range(6000).selectExpr("id % 5900 AS id", "CASE WHEN id % 10 = 9 THEN NULL ELSE id % 3 END AS g")
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    got = [(r.g, r.id) for r in skew.smallest_by_hash(rows, F.md5(F.col("id").cast("string")), k, "id", F.col("g")).collect()]
    want = []
    for g in range(3):
        own = sorted((i % 5900 for i in range(6000) if i % 10 != 9 and i % 3 == g), key=lambda i: (md5(i), i))[:k]
        want += [(g, i) for i in own]
    assert sorted(got) == sorted(want)
    assert skew.smallest_by_hash(rows.limit(0), F.md5(F.col("id").cast("string")), k, "id").count() == 0


def brute_segments(pos, neg, most, least):
    """Every way to cut, with its information value."""
    m, best = len(pos), -np.inf
    for k in range(most):
        for cuts in itertools.combinations(range(1, m), k):
            ends = [0, *cuts, m]
            p, n = (np.array([x[a:b].sum() for a, b in zip(ends, ends[1:])]) for x in (pos, neg))
            if (p + n < max(least, 1)).any():
                continue
            rate = p / (p + n)
            if not ((np.diff(rate) > 0).all() or (np.diff(rate) < 0).all()):
                continue
            a, b = (p + 0.5) / (pos.sum() + 0.5), (n + 0.5) / (neg.sum() + 0.5)
            best = max(best, float(((a - b) * np.log(a / b)).sum()))
    return best


def value_of(ends, pos, neg):
    ends = [0, *ends]
    p, n = (np.array([x[a:b].sum() for a, b in zip(ends, ends[1:])]) for x in (pos, neg))
    a, b = (p + 0.5) / (pos.sum() + 0.5), (n + 0.5) / (neg.sum() + 0.5)
    rate = p / (p + n)
    assert (np.diff(rate) > 0).all() or (np.diff(rate) < 0).all()
    return float(((a - b) * np.log(a / b)).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=9).filter(lambda c: sum(map(sum, c)) > 0), st.integers(1, 5), st.sampled_from([0, 0.05, 0.2]))
def test_best_segments(cells, most, share):
    pos, neg = (np.array(x) for x in zip(*cells))
    least = share * (pos.sum() + neg.sum())
    ends = binning.best_segments(pos, neg, most, least)
    assert ends[-1] == len(pos) and len(ends) <= most and ends == sorted(set(ends))
    assert value_of(ends, pos, neg) == pytest.approx(brute_segments(pos, neg, most, least), abs=1e-9)


def test_monotone_edges(spark):
    rows = spark.range(4000).selectExpr("cast(id % 1000 as double) AS x", "cast(CASE WHEN id % 1000 >= 700 THEN id % 4 > 0 WHEN id % 1000 >= 300 THEN id % 2 = 0 ELSE id % 5 = 0 END AS int) AS label", "cast(NULL AS double) AS none", "1.0D AS flat")
    edges = binning.monotone_edges(rows, ["x", "none", "flat"], most=3, n_prebins=10)
    assert edges["none"] is None and edges["flat"] == [1.0, 1.0] and [round(e / 100) for e in edges["x"]] == [0, 3, 7, 10]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 257, 10_000])
def test_permutation(n):
    ranks = np.arange(n)
    for seed in (0, 1, 99):
        out = models.permuted(ranks, n, np.full(n, seed))
        assert sorted(out.tolist()) == ranks.tolist()
        if n > 200:
            assert abs(np.corrcoef(ranks, out)[0, 1]) < 0.2 and (out == ranks).mean() < 0.05


def test_importance_finds_the_family(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS split", "cast(id * 7919 % 10 >= 5 AS int) AS label", "cast(id * 7919 % 10 AS double) AS good_a", "cast(id * 7919 % 10 AS double) AS good_b", "cast(id * 31 % 17 AS double) AS noise")
    got = {r.family: r for r in models.group_permutation_importance(rows, ["good_a", "good_b", "noise"], "label", "id").collect()}
    assert got["good"].base_auc == 1 and got["good"]["drop"] > 0.3 and abs(got["base"]["drop"]) < 0.01 and got["good"].columns == "good_a,good_b"


@pytest.mark.parametrize("more_control", [False, True])
def test_perfect_uplift(spark, more_control):
    """The closed form equals the curve of the ideal scores, row by row."""
    rng = np.random.default_rng(3)
    n = 500
    arm = rng.integers(0, 2, n)
    y = (rng.random(n) < (np.where(arm == 0, 0.8, 0.4) if more_control else 0.5 + 0.2 * arm)).astype(int)
    score = np.round(rng.random(n) + 0.3 * (arm == y), 2)
    table = spark.createDataFrame([(float(s), int(t), int(v)) for s, t, v in zip(score, arm, y)] + [(None, 1, 1), (0.5, None, 0)], "s double, t int, y int")

    def area(s):
        x, g = [0], [0.0]
        for v in sorted(set(s.tolist()), reverse=True):
            own = s >= v
            a, b = own & (arm == 1), own & (arm == 0)
            x.append(own.sum())
            g.append(((y[a].mean() if a.any() else 0) - (y[b].mean() if b.any() else 0)) * own.sum())
        return np.trapezoid(g, x) - g[-1] * x[-1] / 2

    extra = y if ((y == 1) & (arm == 0)).sum() > ((y == 0) & (arm == 1)).sum() else arm
    r = uplift.normalized_auuc(table, "s", "t", "y").first()
    assert r.raw == pytest.approx(area(score)) and r.perfect == pytest.approx(area(2.0 * (y == arm) + extra)) and r.normalized == pytest.approx(r.raw / r.perfect)
    assert uplift.normalized_auuc(table.filter("t = 1"), "s", "t", "y").first().normalized is None
