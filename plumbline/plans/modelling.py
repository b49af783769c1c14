"""Queries backed by models, audits, and streams: SQL cannot express most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.primitives import melt, written
from plumbline.operators import binning, drift, features, leakage, models, profile, rank_matrix
from plumbline.streaming import monitor

from .registry import query
from .views import NUMERIC, long_sample, over_sample, read, sample, tokens

FE = ["c_acctbal", "n_lines", "sum_qty", "avg_disc"]


@query("d11_leakage_audit")
def _(spark, d):
    rows = written(sample(spark, d), "sample")
    collapses = drift.token_drift(tokens(spark, d), "seq", "day", F.col("day") < "2024-01-20")
    return leakage.leakage_audit(
        binning.univariate_auc(melt(rows, NUMERIC, ["label"])), profile.identifier_like(rows, ["id", "pday", "o_custkey"]), profile.entity_overlap(rows, "o_custkey"), rows.columns, ["label", "outcome"],
        leakage.duplicate_rate(rows.drop("id")), collapses, rank_matrix.target_spearman(rows, NUMERIC, "outcome"),
    )


@query("d12_leak_classify")
def _(spark, d):
    long = long_sample(spark, d)
    rows = sample(spark, d)
    shapes = [profile.text_shape(rows, c).select(F.lit(c).alias("feature"), "composite") for c in ("c_mktsegment", "o_orderpriority")]
    return leakage.leak_classify(binning.univariate_auc(long), over_sample(spark, d, lambda rows: profile.feature_quality(rows, NUMERIC)), text=shapes[0].unionByName(shapes[1]))


@query("i6_lr_oof_score")
def _(spark, d):
    return models.lr_oof_score(sample(spark, d), FE, "label", "id")


@query("i7_gbdt_oof_score")
def _(spark, d):
    return models.gbdt_oof_score(sample(spark, d), FE, "label", "id")


@query("h8_tune_candidate")
def _(spark, d):
    part = lambda x, c: x["outcome"] // (1000 * c["step"]) % 10
    return features.tune_candidate(sample(spark, d), part, {"step": (0.5, 20.0)}, {"step": 1.0}, "id", ["outcome"], "label")[1]


@query("i8_pca_features")
def _(spark, d):
    return models.pca_features(read(spark, d, "embeddings"), "embedding", "vec_id", 8)


@query("i9_cluster_features")
def _(spark, d):
    return models.cluster_features(read(spark, d, "embeddings"), "embedding", "vec_id")


@query("l3_treatment_predictability")
def _(spark, d):
    return models.treatment_predictability(sample(spark, d), FE, "arm", "id")


@query("l11_s_learner")
def _(spark, d):
    return models.s_learner(sample(spark, d), FE, "arm", "label", "id")


@query("l12_t_learner")
def _(spark, d):
    return models.t_learner(sample(spark, d), FE, "arm", "label", "id")


@query("l16_importance_table")
def _(spark, d):
    return models.importance_table(sample(spark, d), FE, "label")


@query("m6_sample_noise_check")
def _(spark, d):
    rows = sample(spark, d)
    return models.sample_noise_check(rows, rows.filter("split <> 'train'"), "id", "label", "score", 0.01)


@query("m8_local_ambiguity")
def _(spark, d):
    return models.local_ambiguity(sample(spark, d), NUMERIC[:4], "label")


@query("m9_sample_size_curve")
def _(spark, d):
    return models.sample_size_curve(sample(spark, d), FE, "label", "id")


@query("m9_last_step")
def _(spark, d):
    return models.last_step(models.sample_size_curve(sample(spark, d), FE, "label", "id", (0.125, 0.5, 1.0)))


@query("m9_feature_count_curve")
def _(spark, d):
    return models.feature_count_curve(sample(spark, d), FE, "label", "id")


@query("m10_group_permutation_importance")
def _(spark, d):
    return models.group_permutation_importance(sample(spark, d), FE, "label", "id")


@query("m11_incremental_gain")
def _(spark, d):
    return models.incremental_gain(sample(spark, d), FE[:2], FE[2], "label", "id")


@query("m11_fusion_gain")
def _(spark, d):
    return models.fusion_gain(sample(spark, d), FE[:2], FE[2:], "label", "id")


@query("m12_hurdle_regression")
def _(spark, d):
    return models.hurdle_regression(sample(spark, d), FE, "outcome", "id", 100000.0)


def _streamed(spark, d, make):
    """The events as a file stream through make, into a Parquet sink, read back."""
    events = read(spark, d, "events").select("event_id", "ts", "value", "event_type").orderBy("ts")
    source = written(events, "events")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    made = make(stream)
    monitor.run_once(made, f"{folder}-out", f"{folder}-state")
    return spark.read.schema(made.schema).parquet(f"{folder}-out")


@query("x1_row_local_view", "SELECT event_id, value * 2 AS twice FROM events", "twice")
def _(spark, d):
    return _streamed(spark, d, lambda s: monitor.row_local_view(s, lambda x: x.select("event_id", (F.col("value") * 2).alias("twice"))))


@query("x2_windowed_bins", "WITH n AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT date_trunc('day', ts) AS start, least(CAST(floor(value / 5) AS BIGINT), 9) AS bin, count(*) AS n FROM events, n GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= any_value(mark)")
def _(spark, d):
    return _streamed(spark, d, lambda s: monitor.windowed_bins(s, "ts", "value", F.least(F.floor(F.col("value") / 5), F.lit(9)).cast("long")))


@query("x3_label_monitor", "WITH n AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT date_trunc('day', ts) AS start, count(*) AS volume, avg(CAST(event_type = 'error' AS INT)) AS rate FROM events, n GROUP BY 1 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= any_value(mark)", "rate")
def _(spark, d):
    return _streamed(spark, d, lambda s: monitor.label_monitor(s, "ts", F.col("event_type") == "error"))
