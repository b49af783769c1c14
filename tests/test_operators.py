"""Planted signals and edge cases that the given tables don't hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import primitives
from plumbline.functions.primitives import global_rank, melt, prefix_sums
from plumbline.operators import binning, comparison, drift, evaluation, features, leakage, profile, ranking, screening, splits, text, typing, uplift
from plumbline.sources import tables


@pytest.fixture(scope="module")
def signal(spark):
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 10, float(i * 7919 % 101), None if i % 3 else 1.0, "train" if i < 600 else "oot", i // 100) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, label int, signal double, noise double, sparse double, split string, day int")


def one(df):
    return df.first().asDict()


def test_signal_beats_noise(signal):
    long = melt(signal, ["signal", "noise"], ["id", "label", "split"])
    iv = {r.feature: r for r in binning.iv_table(signal, ["signal", "noise"]).collect()}
    assert iv["signal"].iv > 1 > 0.2 > iv["noise"].iv and iv["signal"].auc > 0.95 > iv["noise"].auc
    auc = {r.feature: r.auc for r in binning.univariate_auc(long).collect()}
    assert auc["signal"] == pytest.approx(1.0) and auc["noise"] < 0.6


def test_one_class_is_null(signal):
    r = binning.iv_table(signal.withColumn("label", F.lit(1)), ["signal"]).first()
    assert r.iv is None and r.auc is None
    assert one(ranking.auc(signal.withColumn("label", F.lit(0)), "label", "signal"))["auc"] is None
    assert one(ranking.pr_auc(signal.withColumn("label", F.lit(0)), "label", "signal"))["pr_auc"] is None


def test_constant_and_all_null(spark, signal):
    rows = signal.withColumn("const", F.lit(3.0)).withColumn("empty", F.lit(None).cast("double"))
    long = melt(rows, ["const", "empty"], ["label", "split"])
    assert {r.feature: r.auc for r in binning.univariate_auc(long).collect()} == {"const": None}
    stats = {r.feature: r for r in profile.basic_stats(rows, ["const", "empty", "gone"]).collect()}
    assert stats["empty"].n == 0 and stats["empty"].mean is None and stats["gone"].dtype == "MISSING_COL"
    psi = {r.feature: r.psi for r in drift.psi_numeric(rows, ["const", "empty"]).collect()}
    assert psi["const"] == pytest.approx(0.0)
    quality = {(r.split, r.feature): r.severity for r in profile.quality_by_split(long).collect()}
    assert set(quality.values()) == {"severe"}
    kept = {r.feature: r.reasons for r in screening.boundary_filter(profile.basic_stats(rows, ["const", "empty"]), binning.iv_table(rows, ["const", "empty"]), 1000).collect()}
    assert kept == {"const": "constant", "empty": "all_missing"}


def test_drift_is_seen(spark):
    rows = [(float(i % 50 + (40 if i >= 500 else 0)), float(i % 50), "train" if i < 500 else "oot") for i in range(1000)]
    psi = {r.feature: r.psi for r in drift.psi_numeric(spark.createDataFrame(rows, "drift double, stable double, split string"), ["drift", "stable"]).collect()}
    assert psi["drift"] > 1 and psi["stable"] == pytest.approx(0, abs=1e-9)


def test_token_collapse(spark):
    rows = [(m, "a@1,b" if m < 3 else "b") for m in range(5) for _ in range(20)]
    out = {(r.period, r.token): r.collapsed for r in drift.token_drift(spark.createDataFrame(rows, "m int, seq string"), "seq", "m", F.col("m") < 2).collect()}
    assert out[3, "a"] and out[4, "a"] and not out[2, "a"] and not out[4, "b"]


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, i * 7919 % 50, "g" if i % 3 else None) for i in range(500)], "id long, v long, g string")
    want = sorted(((r.v, r.id) for r in rows.collect()))
    for n in (1, 7):
        got = {r.id: r["rank"] for r in global_rank(rows.repartition(n), ["v", "id"]).collect()}
        assert got == {i: k for k, (_, i) in enumerate(want)}
    down = {r.id: r.s for r in prefix_sums(rows, ["-v", "id"], {"s": F.col("v")}, ["g"], None).collect()}
    for g in ("g", None):
        total = 0
        for r in sorted((r for r in rows.collect() if r.g == g), key=lambda r: (-r.v, r.id)):
            total += r.v
            assert down[r.id] == total
    assert global_rank(rows.limit(0), ["v", "id"]).count() == 0


def test_tied_scores(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (2, 1, 0.5), (3, 0, 0.1)], "id long, label int, s double")
    assert one(ranking.auc(rows, "label", "s"))["auc"] == pytest.approx(0.75)
    assert one(ranking.ks(rows, "label", "s"))["ks"] == pytest.approx(0.5)
    assert one(ranking.pr_auc(rows, "label", "s"))["pr_auc"] == pytest.approx(2 / 3)
    assert evaluation.rank_bins(rows, "s", "id").count() == 0  # fewer rows than bins need


def test_splits_refuse_bad_input(spark, signal):
    with pytest.raises(ValueError):
        splits.split_by_ranges(signal, "day", [("a", "2", "1")])
    with pytest.raises(ValueError):
        splits.split_by_row_ratio(signal.limit(2), "day", [0.98, 0.01, 0.01], "id")
    with pytest.raises(ValueError):
        splits.window_bounds("20240101")
    with pytest.raises(ValueError):
        splits.split_by_filters(signal, None, None)
    groups = splits.split_by_group(signal, "day", [0.5, 0.3, 0.2], 1)
    assert groups.groupBy("day").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_types_and_dates(spark):
    rows = spark.createDataFrame([("1", "20240131", "2024-01"), ("x", "2024-02-01", "202402"), (None, "20249999", "2024-02-01"), ("2", "junk", "2024-02-02")], "a string, d string, m string")
    assert [str(r[0]) if r[0] else None for r in rows.select(typing.normalize_date("d")).collect()] == ["2024-01-31", "2024-02-01", None, None]
    assert [r[0] for r in rows.select(typing.month_label("m")).collect()] == ["2024-01", "2024-02", "2024-02", None]
    assert dict(typing.coerce_numeric(rows, ["a"], 0.5).dtypes)["a"] == "double" and dict(typing.coerce_numeric(rows, ["a"]).dtypes)["a"] == "string"
    with pytest.raises(ValueError):
        typing.resolve_features(["a", "y"], target="y", white_list=["y"])


def test_keys(spark):
    rows = spark.createDataFrame([(1, "d", "p", 0), (1, "d", "q", 1), (2, "d", "p", 0), (2, "d", "p", 1)], "id long, dt string, f string, y int")
    keys = [r.sample_key for r in typing.sample_key(rows, "dt", "id", "y").collect()]
    assert len(set(keys)) == 4
    with pytest.raises(ValueError):
        typing.align_by_key(rows, rows, ["id"])
    with pytest.raises(ValueError):
        features.attach_features(rows, rows.select("id", "f"), ["id"])


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "20240101", 1.5), (1, "20240102", 2.5), (2, "20240102", 3.5)], "user long, dt string, x double")
    tables.write_table(rows, f"file://{tmp_path}/t.csv")
    assert tables.read_sample(spark, f"file://{tmp_path}/t.csv").count() == 3
    lagged = {(r.user, r.dt): r.x for r in tables.fetch_sample_features(rows.select("user", "dt"), rows, ["user", "dt"], "dt", "20240101", "20240103", 1).collect()}
    assert lagged == {(1, "20240101"): None, (1, "20240102"): 1.5, (2, "20240102"): None}
    for bad in ({"lag_day": 2}, {"lag_day": 1, "keys": ["user"]}):
        with pytest.raises(ValueError):
            tables.fetch_sample_features(rows, rows, bad.get("keys", ["user", "dt"]), "dt", "20240101", "20240103", bad["lag_day"])
    with pytest.raises(ValueError):
        tables.assert_plane_clean(rows, ["x"])


def test_uplift(spark):
    rows = [(i, i % 2, 1 if (i % 2 and i < 200) or i % 10 == 0 else 0, 1 - i / 400) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, arm int, y int, s double")
    a = one(uplift.uplift_areas(df, "s", "arm", "y", "id"))
    b = one(uplift.uplift_areas(df.withColumn("s", -F.col("s")), "s", "arm", "y", "id"))
    assert a["qini"] > 0 > b["qini"]
    assert one(uplift.uplift_areas(df.filter("arm = 1"), "s", "arm", "y", "id")) == {"auuc": None, "qini": None}
    assert {r.support for r in uplift.uplift_bins(df.filter("arm = 1"), "s", "arm", "y", "id").collect()} == {"missing_arm"}
    assert math.isclose(one(uplift.overall_uplift(df, "arm", "y"))["uplift"], 0.3, abs_tol=0.01)


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0.2, 0.0, 0), (1, 0, 0.9, 0.0, 0)], "id long, y int, s double, t double, a int")
    assert one(evaluation.threshold_metrics(df, "y", "s"))["recall"] is None
    assert one(evaluation.top_lift(df, "y", "s", "id", 50))["lift"] is None
    assert one(evaluation.regression_metrics(df, "t", "s"))["mape"] is None
    assert one(uplift.overall_uplift(df, "a", "t"))["relative"] is None
    assert evaluation.level_stats(df, "t", "s").first().ratio is None


def test_bootstrap_and_tests(spark, signal):
    r = one(comparison.paired_bootstrap(signal, "label", "signal", "noise", "id", 10))
    assert r["share_positive"] == 1.0 and r["low"] > 0.3
    p = spark.createDataFrame([(0.001,), (0.04,), (0.08,), (None,), (0.9,)], "p double")
    assert sorted(str(x.p) for x in comparison.benjamini_hochberg(p, "p", 0.1).filter("passed").collect()) == ["0.001", "0.04"]
    assert {r.verdict for r in comparison.aligned_leaderboard(signal, "label", ["signal", "noise"], "id", "noise", 10).collect()} == {"better", "reference"}


def test_text_and_encodings(spark):
    df = spark.createDataFrame([(1, "a^b;c"), (2, None), (3, " ")], "id long, t string")
    assert {r.id: r.t_present for r in text.text_presence(df, ["t"]).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.item for r in text.item_weights(df, "t").collect()} == {"a", "b", "c"}
    pooled = {r.id: list(r.vector) for r in text.chunk_pool(df, "id", "t", 2, lambda s: text.hash_vector(s, 4), 4).collect()}
    assert pooled[2] == [0.0] * 4 and len(pooled[1]) == 4
    coded = features.encode_features(df.filter("id = 1"), df, [], ["t"]).collect()
    assert {r.id: (r["t__MISSING"], r["t__OTHER"]) for r in coded} == {1: (0, 0), 2: (1, 0), 3: (0, 1)}
    with pytest.raises(ValueError):
        features.recency_view(df, "t", ["id"], 1.0, [])
    with pytest.raises(ValueError):
        features.apply_view(df, lambda d: d.limit(1), "id")


def test_leaks(spark):
    auc = spark.createDataFrame([("a", 0.9), ("b", 0.75), ("c", 0.5)], "feature string, auc double")
    quality = spark.createDataFrame([("a", 0.1, False), ("b", 0.1, False), ("c", 0.99, True)], "feature string, distinct_ratio double, high_cardinality boolean")
    assert {r.feature: r.verdict for r in leakage.leak_classify(auc, quality).collect()} == {"a": "banned", "b": "ambiguous", "c": "banned"}
    names = ["due_90d", "due_7d", "note", "tags", "x"]
    auc = spark.createDataFrame([(n, 0.5) for n in names], "feature string, auc double")
    quality = spark.createDataFrame([(n, 0.1, False) for n in names if n not in ("note", "tags")], "feature string, distinct_ratio double, high_cardinality boolean")
    text = spark.createDataFrame([("note", False), ("tags", True)], "feature string, composite boolean")
    got = {r.feature: (r.verdict, r.reason) for r in leakage.leak_classify(auc, quality, "due_30d", 30, text).collect()}
    assert got == {"due_90d": ("banned", "target_window"), "due_7d": ("ambiguous", "target_family"), "note": ("reparse", "text"), "tags": ("reparse", "list"), "x": ("clean", "")}


def test_leakage_rules(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = t([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "x int, y string")
    assert one(leakage.duplicate_rate(rows))["rate"] == pytest.approx(0.4)
    found = leakage.leakage_audit(
        t([("f", 0.9), ("g", 0.5), ("h", None)], "feature string, auc double"), t([("k", 1.0, True), ("m", 0.2, False)], "feature string, unique_ratio double, identifier boolean"),
        t([("train", "oot", 0.1), ("train", "test", 0.0)], "left string, right string, jaccard double"), ["a_label", "b"], ["label"], leakage.duplicate_rate(rows),
        t([("1", "tok", True), ("2", "tok", True), ("2", "ok", False)], "period string, token string, collapsed boolean"), t([("z", 0.99), ("f", 0.2)], "feature string, spearman double"),
    )
    assert {(r.rule, r.subject): round(r.value, 6) for r in found.collect()} == {
        ("target_word", "a_label"): 1.0, ("high_auc", "f"): 0.9, ("identifier", "k"): 1.0, ("entity_overlap", "train/oot"): 0.1, ("duplicate_rows", "rows"): 0.4, ("token_collapse", "tokens"): 1.0, ("high_correlation", "z"): 0.99,
    }


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([2.5]), "d": np.array([1.0, 1.0, 7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("e", None)]
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {r.feature: r.q for r in primitives.quantiles(spark.createDataFrame(rows, "feature string, value double"), at).collect()}
    assert got.pop("e") is None and set(got) == set(groups)
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], at).tolist())


def test_bootstrap_is_the_weighted_auc(spark):
    """Against drawing the weights and counting pairs, with ties over many tasks, nulls and one class."""
    rng = np.random.default_rng(4)
    n, reps = 400, 6
    label, score = rng.integers(0, 2, n), np.where(rng.random(n) < 0.5, 0.25, np.round(rng.random(n), 2))
    rows = [(k, int(y), float(s), 1.0 if k % 2 else None) for k, (y, s) in enumerate(zip(label, score, strict=True))] + [(n, None, 0.1, 0.1), (n + 1, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, label int, s double, t double").repartition(7)
    got = {(r.score, r.replicate): r.auc for r in comparison.bootstrap_auc(df, "label", ["s", "t"], "id", reps, 9).collect()}
    w = comparison.draws(np.arange(n), reps, 9)
    assert abs(comparison.draws(np.arange(20_000), 50, 1).mean() - 1) < 0.01 and abs(comparison.draws(np.arange(20_000), 50, 1).var() - 1) < 0.02
    above = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    for r in range(reps):
        p, q = w[:, r] * (label == 1), w[:, r] * (label == 0)
        assert got["s", r] == pytest.approx(float(p @ above @ q / (p.sum() * q.sum())))
        assert got["t", r] == pytest.approx(0.5)
    assert {r.auc for r in comparison.bootstrap_auc(df.filter("label = 1"), "label", ["s"], "id", 2, 9).collect()} == {None}


def test_slice_and_period_gate(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(y), "ab"[k % 2], "12"[k % 4 // 2], float(y + rng.normal()), float(y + rng.normal())) for k, y in enumerate(rng.integers(0, 2, 1200))]
    df = spark.createDataFrame(rows, "id long, label int, part string, month string, new double, old double")
    got = comparison.slice_and_period_gate(df, "label", "new", "old", ["part"], "month", "id", n_boot=100).collect()
    assert {(r.kind, r.segment) for r in got} == {("slice", "part=a"), ("slice", "part=b"), ("period", "month=1"), ("period", "month=2")}
    se = one(comparison.paired_bootstrap(df, "label", "new", "old", "id", 100))["se"]
    for r in got:
        assert r.se == pytest.approx(se) and r.reach == pytest.approx(se * (2 if r.kind == "period" else 1.959963984540054))
        low = min(x.delta for x in got if x.kind == r.kind)
        assert r.worst == (r.delta == low) and r.passed == (low > -r.reach)
    bad = df.withColumn("new", F.when(F.col("part") == "a", -F.col("old")).otherwise(F.col("old")))
    assert {(r.kind, r.passed) for r in comparison.slice_and_period_gate(bad, "label", "new", "old", ["part"], "month", "id", n_boot=50).collect()} == {("slice", False), ("period", False)}


def test_verdicts_at_a_limit_do_not_hang_on_last_bits(spark):
    up, down = (lambda x: float(np.nextafter(x, 9))), (lambda x: float(np.nextafter(x, -9)))
    rows = [(d, e) for d in (1.13 / 11, -1.13 / 11) for e in (down(abs(d)), abs(d), up(abs(d)), up(2 * abs(d)), 1.001 * abs(d), 2.001 * abs(d))]
    made = comparison.noise_gate(spark.createDataFrame(rows, "d double, se double"), "d", "se", smallest=0.05).collect()
    assert [r.verdict for r in made] == [*["better"] * 3, "likely_better", "likely_better", "noise", *["worse"] * 3, "likely_worse", "likely_worse", "noise"]


def test_rows_without_a_level_are_a_null_level(spark):
    df = spark.createDataFrame([("train", k % 2, "null" if k % 3 else None) for k in range(12)], "split string, arm int, segment string")
    made = uplift.smd_table(df.withColumn("x", F.lit(1.0)), ["x"], ["segment"], "arm")
    assert sorted((r.level is None, r.level) for r in made.filter("variable = 'segment'").collect()) == [(False, "null"), (True, None)]


def test_a_variable_without_variance_has_no_smd_however_rows_are_dealt(spark):
    rows = [("train", k % 2, 1.0, "a") for k in range(600)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows[:98], 1) + spark.sparkContext.parallelize(rows[98:], 1), "split string, arm int, x double, segment string")
    assert df.agg(F.var_pop("x")).first()[0] > 0  # as partial means are merged
    (made,) = uplift.smd_table(df, ["x"], ["segment"], "arm").filter("variable = 'x'").collect()
    assert (made.smd, made.status) == (None, None)


def test_levels_of_a_split_without_an_arm_are_severe(spark):
    df = spark.createDataFrame([("train", k % 2, "ab"[k % 3 > 0]) for k in range(12)] + [("oot", 1, "a")], "split string, arm int, segment string")
    made = uplift.smd_table(df.withColumn("x", F.lit(1.0)), ["x"], ["segment"], "arm").filter("split = 'oot'").collect()
    assert [(r.variable, r.smd is None or math.isnan(r.smd), r.status) for r in sorted(made, key=lambda r: r.variable)] == [("segment", True, "severe"), ("x", True, None)]
