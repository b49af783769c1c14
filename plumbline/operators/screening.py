"""Feature screening over result tables: rules, recommendations, redundancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank_matrix import nearest_ranked


def _reasons(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def _judged(df: DataFrame, reasons: Column) -> DataFrame:
    return df.withColumn("reasons", F.array_join(reasons, ",")).select("feature", "reasons", (F.col("reasons") == "").alias("kept"))


def boundary_filter(stats: DataFrame, iv: DataFrame, total: int) -> DataFrame:
    """feature, reasons, kept: constant, leak (iv over 1), id_like (distinct over 0.9 of the rows), all_missing."""
    rules = _reasons(constant=(F.col("n") > 0) & ((F.col("distinct") <= 1) | (F.col("std") == 0)), leak=F.col("iv") > 1, id_like=F.col("distinct") / F.lit(max(total, 1)) > 0.9, all_missing=F.coalesce(F.col("n"), F.lit(0)) == 0)
    return _judged(stats.join(iv.select("feature", "iv"), "feature", "left"), rules)


def selection_rules(stats: DataFrame, iv: DataFrame, psi: DataFrame, psi_max: float = 0.1, iv_min: float = 0.02, missing_max: float = 0.95) -> DataFrame:
    """feature, reasons, kept: high_psi, low_iv (null too), high_missing."""
    rows = stats.join(iv.select("feature", "iv"), "feature", "left").join(psi.select("feature", "psi"), "feature", "left")
    return _judged(rows, _reasons(high_psi=F.col("psi") > psi_max, low_iv=F.col("iv").isNull() | (F.col("iv") < iv_min), high_missing=F.col("missing_rate") > missing_max))


def recommend_features(quality: DataFrame, psi: DataFrame, base: str = "train") -> DataFrame:
    """feature, keep, reasons, warnings: severe training quality or severe PSI exclude; warnings are counted."""
    q = quality.filter(F.col("split") == base).select("feature", F.col("severity").alias("level"), F.lit("quality").alias("source"))
    found = q.unionByName(psi.select("feature", "level", F.lit("psi").alias("source")))
    reason = F.when(F.col("level") == "severe", F.concat_ws("_", "source", "level"))
    out = found.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return out.select("feature", (F.col("reasons") == "").alias("keep"), "reasons", "warnings")


def gate_signal(auc: DataFrame, stats: DataFrame, psi: DataFrame, least_auc: float = 0.5, least_coverage: float = 0.3, most_psi: float = 0.3) -> DataFrame:
    """feature, auc, coverage, psi, passed."""
    rows = stats.select("feature", (1 - F.col("missing_rate")).alias("coverage"), "distinct").join(auc, "feature", "left").join(psi.select("feature", "psi"), "feature", "left")
    ok = (F.col("auc") >= least_auc) & (F.col("coverage") >= least_coverage) & (F.col("psi") <= most_psi) & (F.col("distinct") > 1)
    return rows.select("feature", "auc", "coverage", "psi", F.coalesce(ok, F.lit(False)).alias("passed"))


def redundancy(df: DataFrame, candidates: Sequence[str], reference: Sequence[str], threshold: float = 0.9, fill: float | None = 0.0) -> DataFrame:
    """feature, nearest, corr, redundant: the largest absolute rank correlation of each candidate with a reference column.

    fill replaces nulls before ranking (the scan); with fill None, rows where
    a side is null are left out of the pair (the gate). df should be a stored table.
    """
    return nearest_ranked(df, candidates, reference, fill).select("*", (F.col("corr") > threshold).alias("redundant"))


def roi_probe(redundant: DataFrame, auc: DataFrame, low: float = 0.5) -> DataFrame:
    """feature, corr, auc, list: white under low correlation and with an AUC over one half, black if redundant, else grey."""
    rows = redundant.join(auc, "feature", "left")
    listed = F.when(F.col("redundant"), "black").when((F.col("corr") < low) & (F.col("auc") > 0.5), "white").otherwise("grey")
    return rows.select("feature", "corr", "auc", listed.alias("list"))


def cross_validate_features(requested: DataFrame, available: DataFrame) -> DataFrame:
    """feature, present of each requested name."""
    have = available.select("feature").distinct().withColumn("present", F.lit(True))
    return requested.select("feature").distinct().join(have, "feature", "left").select("feature", F.coalesce("present", F.lit(False)).alias("present"))
