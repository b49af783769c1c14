"""Model-backed operators against numpy, or against a sample whose answer is known."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import comparison, features, models, ranking, text

N = 600


@pytest.fixture(scope="module")
def sample(spark):
    """label follows x; y = 3 x above zero, else 0; z is noise; the arm follows nothing; y rises by 2 for the treated."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(N):
        x, z, w, arm = *rng.normal(size=3), int(rng.integers(0, 2))
        rows.append((k, ("train", "train", "test", "oot")[k % 4], int(x + 0.3 * rng.normal() > 0), float(x) if k % 17 else None, float(z), float(w), arm, float(max(0.0, 3 * x)), float(x + 2 * arm), int(rng.random() < 0.2 + 0.6 * arm)))
    return spark.createDataFrame(rows, "id long, split string, label int, x double, z double, w double, arm int, spend double, y double, bought int").repartition(3)


def auc(rows, label, score):
    pos, neg = ([r[score] for r in rows if r[label] == y] for y in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("make", [models.lr_oof_score, models.gbdt_oof_score])
def test_oof_scores(spark, sample, make):
    got = make(sample, ["x", "z"], "label", "id").join(sample, "id").collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    for split in ("train", "test"):
        assert auc([r for r in got if r.split == split], "label", "score") > 0.85
    # the noise alone predicts nothing, of the training rows neither, as no model saw its own
    assert 0.35 < auc([r for r in make(sample, ["z"], "label", "id").join(sample, "id").collect() if r.split == "train"], "label", "score") < 0.62
    one = sample.withColumn("label", F.lit(1))
    assert {r.score for r in make(one, ["x"], "label", "id").collect()} == {None}


def test_pca_is_numpys(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(data)], "id long, v array<double>")
    got = np.array([[r.pca_0, r.pca_1] for r in models.pca_features(df, "v", "id", 2, F.col("id") < 60).orderBy("id").collect()])
    fit = data[:60]
    axes = np.linalg.svd(fit - fit.mean(0), full_matrices=False)[2][:2]
    want = (data - fit.mean(0)) @ axes.T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_clusters_are_nearest_centres(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    data = np.concatenate([c + rng.normal(size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(data)], "id long, v array<double>")
    got = models.cluster_features(df, "v", "id", 3).orderBy("id").collect()
    for g in range(3):
        part = got[30 * g : 30 * g + 30]
        assert len({r.cluster for r in part}) == 1
        middle = data[30 * g : 30 * g + 30].mean(0)
        assert [r.distance for r in part] == pytest.approx(np.linalg.norm(data[30 * g : 30 * g + 30] - middle, axis=1).tolist())
    assert len({r.cluster for r in got}) == 3


def test_arm_predictability(sample):
    fair = models.treatment_predictability(sample, ["x", "z", "w"], "arm", "id").first()
    assert fair.treated + fair.control == N and 0.35 < fair.auc < 0.65 and fair.level in ("ok", "warning")
    told = models.treatment_predictability(sample.withColumn("arm", (F.col("z") > 0).cast("int")), ["x", "z"], "arm", "id").first()
    assert told.auc > 0.95 and told.level == "severe" and told.importances[0].feature == "z" and sum(g.gain for g in told.importances) == pytest.approx(1)
    few = models.treatment_predictability(sample.limit(40), ["x"], "arm", "id").first()
    assert few.auc is None and few.importances == []


@pytest.mark.parametrize("learner", [models.s_learner, models.t_learner])
def test_uplift_learners(sample, learner):
    got = learner(sample, ["x", "z"], "arm", "y", "id", binary=False).collect()
    assert len(got) == N and all(abs(r.uplift - (r.p1 - r.p0)) < 1e-12 for r in got)
    assert 1.5 < np.mean([r.uplift for r in got]) < 2.5
    bought = learner(sample, ["x", "z"], "arm", "bought", "id").collect()
    assert 0.4 < np.mean([r.uplift for r in bought]) < 0.8


@pytest.mark.parametrize("learner", [models.s_learner, models.t_learner])
def test_repeated_keys_stay(spark, learner):
    """Scorings follow each other without a join, so rows of one key are each scored once."""
    rows = spark.range(400).selectExpr("id % 100 AS id", "'train' AS split", "cast(id % 7 AS double) AS x", "cast(id % 2 AS int) AS arm", "cast(id % 7 + id % 2 AS double) AS y")
    got = learner(rows, ["x"], "arm", "y", "id", binary=False)
    assert got.count() == 400 and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_importances(sample):
    got = {r.feature: r for r in models.importance_table(sample, ["x", "z"], "label").collect()}
    assert got["x"]["rank"] == 1 and got["z"]["rank"] == 2 and got["x"].share > 0.6 and got["x"].share + got["z"].share == pytest.approx(1)


def test_sample_noise(sample):
    rows = sample.withColumn("s", F.coalesce("x", F.lit(0.0)))
    got = models.sample_noise_check(rows, rows.filter("id % 4 = 0"), "id", "label", "s", 0.01, 50).first()
    for part, se in ((rows, got.se_full), (rows.filter("id % 4 = 0"), got.se_sample)):
        assert comparison.bootstrap_ci(part, "label", "s", "id", 50).first().se == pytest.approx(se)
    assert got.se_sample > got.se_full and got.ratio == pytest.approx(got.se_sample / 0.02) and got.usable == (got.ratio <= 1)


def test_ambiguity(spark, sample):
    clear = models.local_ambiguity(sample, ["x", "z"], "y").first()
    assert clear.dims == round(math.log(N // 20, 3)) and clear.cells <= 3**clear.dims and clear.total == pytest.approx(np.var([r.y for r in sample.collect()]))
    assert clear.ambiguity == pytest.approx(clear.within / clear.total) and 0 < clear.ambiguity < 1
    noise = models.local_ambiguity(sample.withColumn("n", F.rand(1)), ["x", "z"], "n").first()
    assert noise.ambiguity > clear.ambiguity and models.local_ambiguity(sample.limit(40), ["x"], "y").first().dims == 2
    flat = models.local_ambiguity(sample, ["x", "z"], "label_").first() if "label_" in sample.columns else models.local_ambiguity(sample.withColumn("c", F.lit(1.0)), ["x"], "c").first()
    assert flat.ambiguity is None


def test_curves(spark, sample):
    got = models.sample_size_curve(sample, ["x"], "label", "id", (0.5, 1.0), (1, 2)).collect()
    assert [(r.fraction, r.seed) for r in got] == [(0.5, 1), (0.5, 2), (1.0, 1)] and got[2].rows == N / 2 and all(r.auc > 0.8 for r in got)
    curve = spark.createDataFrame([(0.25, s, 10, 0.6 + s / 1000) for s in (1, 2)] + [(0.5, s, 20, 0.7 + s / 1000) for s in (1, 2)] + [(1.0, 1, 40, 0.8)], "fraction double, seed int, rows long, auc double")
    last = models.last_step(curve).first()
    assert last.gain == pytest.approx(0.8 - 0.7015) and last.se == pytest.approx(math.sqrt(2 / 2) * 0.0005) and not last.covers_zero and last.steep
    alone = models.last_step(curve.filter("seed = 1")).first()
    assert alone.se is None and alone.covers_zero and not alone.steep
    assert models.last_step(curve.filter("fraction = 1")).count() == 0
    steps = models.feature_count_curve(sample, ["z", "x"], "label", "id", (0.5, 1.0)).collect()
    assert [r.n_features for r in steps] == [1, 2] and steps[1].gain == pytest.approx(steps[1].auc - steps[0].auc) and steps[1].gain > 0.2


def test_families_and_permutation(sample):
    assert models.families(["a_x", "a_y", "b2_z", "plain", "_odd"]) == {"a": ["a_x", "a_y"], "b2": ["b2_z"], "base": ["plain"], "": ["_odd"]}
    rows = sample.withColumnRenamed("x", "good_x").withColumn("good_z", F.col("z"))
    got = {r.family: r for r in models.group_permutation_importance(rows, ["good_x", "good_z", "w"], "label", "id", 1).collect()}
    assert set(got) == {"good", "base"} and got["good"].columns == "good_x,good_z" and got["good"].drop > 0.2 > abs(got["base"].drop)


def test_gains(sample):
    got = {r.split: r for r in models.incremental_gain(sample, ["z"], "x", "label", "id", (1, 2)).collect()}
    assert set(got) == {"test", "oot"} and all(r.gain > 0.2 and r.lower <= r.gain for r in got.values())
    fused = models.fusion_gain(sample, ["z"], ["x", "w"], "label", "id", 0.1).first()
    assert fused.passed and fused.gain == pytest.approx(fused.fused_auc - fused.base_auc) and fused.fused_auc > 0.8
    assert not models.fusion_gain(sample, ["x"], ["w"], "label", "id", 0.1).first().passed


def test_hurdle(sample):
    got = models.hurdle_regression(sample, ["x", "z"], "spend", "id").join(sample.select("id", "x", "spend"), "id").collect()
    assert len(got) == N and all(r.prediction == pytest.approx(r.p * r.m) and 0 <= r.p <= 1 and r.m >= 0 for r in got)
    near = [r for r in got if r.x is not None]
    assert np.mean([abs(r.prediction - r.spend) for r in near]) < 0.5 * np.mean([abs(np.mean([q.spend for q in near]) - r.spend) for r in near])


def test_hashes_are_crc32():
    import zlib

    texts = ["", "a", "ab", "aéb 日本🙂", "🙂", "x" * 50, "", "né"]
    want = np.zeros((len(texts), 13))
    for k, t in enumerate(texts):
        for gram in [*t, *(t[i : i + 2] for i in range(len(t) - 1))]:
            want[k, zlib.crc32(gram.encode()) % 13] += 1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(text.hash_vector(pd.Series(texts), 13), want) and text.hash_vector(pd.Series([], dtype=str), 4).shape == (0, 4)


def test_hash_vectors(spark):
    one, two, same = np.asarray(text.hash_vector(pd.Series(["one two one", "two", "one two one"]), 8))
    assert len(one) == 8 and np.array_equal(one, same) and not np.array_equal(one, two)
    df = spark.createDataFrame([(1, "one two one"), (2, "two"), (3, None), (4, "two")], "id long, t string")
    got = {r.id: np.array(r.vector) for r in text.hash_encode(df, "t", 8).collect()}
    assert np.allclose(got[1], one) and np.allclose(got[2], two) and np.allclose(got[4], two) and set(got) == {1, 2, 3, 4}


def test_tuning(spark, sample):
    """A fold of x at the right place ranks the label; the default one does not."""
    rows = sample.withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("label", (F.abs(F.col("x") - 1) < 0.5).cast("int"))
    fold = lambda x, c: -(x["x"] - c["at"]).abs()
    chosen, tried = features.tune_candidate(rows, fold, {"at": (-3.0, 3.0)}, {"at": -2.0}, "id", ["x"], "label")
    assert abs(chosen["at"] - 1) < 0.35 and tried.count() == 1 + 24 + 4
    best = tried.orderBy(F.desc("auc")).first()
    assert best.auc > 0.95 and best["at"] == pytest.approx(chosen["at"])
    assert features.tune_candidate(rows.withColumn("label", F.lit(1)), fold, {"at": (-3.0, 3.0)}, {"at": -2.0}, "id", ["x"], "label", 2, 2)[0] == {"at": -2.0}
    constant = lambda x, c: pd.Series([1.0] * len(x))
    assert features.tune_candidate(rows, constant, {"at": (0.0, 1.0)}, {"at": 0.5}, "id", ["x"], "label", 2, 2)[0] == {"at": 0.5}
    assert ranking.auc(rows, "label", "x").first()[0] is not None


def test_error_function(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double")
    assert all(abs(r.e - math.erf(r.x)) < 1e-6 for r in df.select("x", features.erf_column(F.col("x")).alias("e")).collect())


def test_permutation_donors_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), "train" if k % 3 else "test", int(x > 0.5), float(x), float(y)) for k, x, y in zip(range(600), rng.random(600), rng.random(600))]
    df = spark.createDataFrame(rows, "id long, split string, label int, a_x double, b_y double")
    seen = []
    whole = models.auc

    def auc(scored, *args):
        seen.append(scored._jdf.queryExecution().executedPlan().toString())
        return whole(scored, *args)

    monkeypatch.setattr(models, "auc", auc)
    models.group_permutation_importance(df, ["a_x", "b_y"], "label", "id").collect()
    assert "BroadcastHashJoin" not in seen[-1] and "SortMergeJoin" in seen[-1]


def test_sources_are_read_once_and_models_fitted_once(spark, monkeypatch):
    rows = [(k, ("train", "train", "test", "oot")[k % 4], k * 7 % 5 % 2, None if k % 9 == 0 else float(k % 13), float(k * 3 % 11)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, split string, label int, a double, b double")
    made = models.filled(df, ["a"], ["id"])
    assert all("/filled-" in f for f in made.inputFiles()) and made.inputFiles()
    assert {r.a for r in made.filter("id % 9 = 0").collect()} == {float(np.median([r[3] for r in rows if r[3] is not None]))}
    fits, whole = [], models._stages
    monkeypatch.setattr(models, "_stages", lambda *args: fits.append(1) or whole(*args))
    got = {r.split: r.gain for r in models.incremental_gain(df, ["a"], "b", "label", "id", seeds=(1, 2)).collect()}
    assert len(fits) == 4 and set(got) == {"test", "oot"}
