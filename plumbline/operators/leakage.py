"""Leakage audit: findings of rules over the profile tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name that ends in a window: its stem and its days.
WINDOW = r"^(.+?)_?([0-9]+)_?(d|day|days|w|m|month|months)$"


def duplicate_rate(df: DataFrame) -> DataFrame:
    """One row: rate, the share of rows that repeat an earlier one in all columns."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg((1 - F.count("*") / F.sum("n")).alias("rate"))


def leakage_audit(auc: DataFrame, identifiers: DataFrame, overlap: DataFrame, columns: Sequence[str], target_words: Sequence[str], duplicates: DataFrame, collapses: DataFrame | None = None, correlations: DataFrame | None = None, most_auc: float = 0.85, most_correlation: float = 0.95) -> DataFrame:
    """rule, subject, value of each finding.

    Rules: a target word in a name; a single feature's AUC, or for a numeric
    target its absolute rank correlation, above the limit; identifiers;
    entities in several splits; more than 1 % duplicate rows; tokens whose
    coverage collapses in some period (value: how many).

    auc: E6; identifiers: D4; overlap: D9; duplicates: duplicate_rate;
    collapses: F7; correlations: E5. Null values find nothing.
    """
    named = [("target_word", c, 1.0) for c in columns if any(w in c.lower() for w in target_words)]
    out = [auc.sparkSession.createDataFrame(named, "rule string, subject string, value double")]

    def rule(df: DataFrame, name: str, subject, value, where) -> None:
        out.append(df.filter(where).select(F.lit(name).alias("rule"), subject.alias("subject"), value.cast("double").alias("value")))

    rule(auc, "high_auc", F.col("feature"), F.col("auc"), F.col("auc") > most_auc)
    rule(identifiers, "identifier", F.col("feature"), F.col("unique_ratio"), F.col("identifier"))
    rule(overlap, "entity_overlap", F.concat_ws("/", "left", "right"), F.col("jaccard"), F.col("jaccard") > 0)
    rule(duplicates, "duplicate_rows", F.lit("rows"), F.col("rate"), F.col("rate") > 0.01)
    if collapses is not None:
        fallen = collapses.filter("collapsed").agg(F.count_distinct("token").alias("n"))
        rule(fallen, "token_collapse", F.lit("tokens"), F.col("n"), F.col("n") > 0)
    if correlations is not None:
        rule(correlations, "high_correlation", F.col("feature"), F.col("spearman"), F.col("spearman") > most_correlation)
    return functools.reduce(DataFrame.unionByName, out)


def leak_classify(auc: DataFrame, quality: DataFrame, target: str = "label", window_days: int = 0, text: DataFrame | None = None, banned_auc: float = 0.85, doubtful_auc: float = 0.70) -> DataFrame:
    """feature, auc, verdict, reason of each feature, by the first rule that holds.

    banned: the target's own stem over a window that reaches the performance
    window (window_days of it), an AUC above banned_auc, nearly unique values.
    reparse: text, or a text that is a list. ambiguous: an AUC above
    doubtful_auc, or the target's stem. Else clean.

    auc: E6; quality: D2; text: feature, composite (D5) of the columns that are
    no numbers. A feature in only one of the tables counts with nulls.
    """
    rows = quality.select("feature", "high_cardinality").join(auc, "feature", "full")
    if text is not None:
        rows = rows.join(text.select("feature", "composite", F.lit(True).alias("text")), "feature", "full")
    else:
        rows = rows.withColumn("composite", F.lit(False)).withColumn("text", F.lit(False))
    length = F.regexp_extract("feature", WINDOW, 2).cast("int") * F.when(F.regexp_extract("feature", WINDOW, 3).startswith("m"), 30).when(F.regexp_extract("feature", WINDOW, 3) == "w", 7).otherwise(1)
    stem = F.regexp_extract("feature", WINDOW, 1)
    same = stem == F.coalesce(F.nullif(F.regexp_extract(F.lit(target), WINDOW, 1), F.lit("")), F.lit(target))
    rules = [
        (same & (length >= window_days), "banned", "target_window"), (F.col("auc") > banned_auc, "banned", "high_auc"), (F.col("high_cardinality"), "banned", "near_unique"),
        (F.col("composite"), "reparse", "list"), (F.col("text"), "reparse", "text"),
        (same, "ambiguous", "target_family"), (F.col("auc") > doubtful_auc, "ambiguous", "doubtful_auc"),
    ]
    verdict, reason = F.lit("clean"), F.lit("")
    for holds, what, why in reversed(rules):
        verdict, reason = F.when(holds, what).otherwise(verdict), F.when(holds, why).otherwise(reason)
    return rows.select("feature", "auc", verdict.alias("verdict"), reason.alias("reason"))
