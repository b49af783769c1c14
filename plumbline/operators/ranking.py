"""Tie-aware metrics from score counts: AUC, KS, average precision, average ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.primitives import prefix_sums, spread, written
from plumbline.functions.skew import skewed_join


def score_counts(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """groups, score, pos, neg: one row for each distinct score, null scores and labels left out."""
    w = F.lit(1) if weight is None else weight
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg")
    )


def curve(counts: DataFrame, groups: Sequence[str] = (), falling: bool = False) -> DataFrame:
    """score_counts with cum_pos and cum_neg up to each score, in a global order dealt over tasks."""
    return prefix_sums(counts, ["-score" if falling else "score"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, groups, None)


def auc_of(counts: DataFrame, groups: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null for one class."""
    below = F.col("cum_neg") - F.col("neg")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return curve(counts, groups).groupBy(*groups).agg((area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias(name))


def auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    return auc_of(score_counts(df, label, score, groups, weight), groups)


def ks(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Largest gap of the two classes' distribution functions at distinct scores."""
    steps = curve(score_counts(df, label, score, groups), groups)
    totals = steps.groupBy(*groups).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    joined = steps.join(totals, list(groups)) if groups else steps.crossJoin(F.broadcast(totals))  # one row
    gap = F.abs(F.expr("try_divide(cum_pos, __p) - try_divide(cum_neg, __n)"))
    return joined.groupBy(*groups).agg(F.max(gap).alias("ks"))


def pr_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall gained there."""
    steps = curve(score_counts(df, label, score, groups), groups, falling=True)
    gained = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return steps.groupBy(*groups).agg((gained / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def correlation(x: str, y: str) -> Column:
    """Pearson, over rows where neither is null; null if a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    both_spread = spread(F.stddev_pop, a) * spread(F.stddev_pop, b)
    return F.covar_pop(a, b) / F.when(both_spread > 1e-300, both_spread)


def average_ranks(long: DataFrame, groups: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """long with rank (1-based, ties share their mean) of the non-null values in each group.

    Rows of a value that many share are dealt over several tasks, with its rank in each.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__c"))
    ranked = prefix_sums(counts, [value], {"__upto": F.col("__c")}, groups, None)
    keys = [*groups, value]
    ranks = written(ranked.select(*groups, value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias("rank")), "ranks")
    return skewed_join(long.filter(F.col(value).isNotNull()), ranks, keys)
