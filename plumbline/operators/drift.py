"""Drift: PSI in its variants, token drift, KS between groups of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import wide
from plumbline.functions.primitives import bin_index, inner, prefix_sums, quantile_edges

from .binning import Edges, Features, binned, equal_freq_edges, iv_of, quality_report, top_levels, woe_table


def psi_terms(cells: DataFrame, groups: Sequence[str], share) -> DataFrame:
    """groups, psi from groups, bin, a, b (rows of base and comparison): the sum of (q - p) ln(q / p) with shares made by share(n, total)."""
    w = Window.partitionBy(*groups)  # a row for each bin
    p, q = share(F.col("a"), F.sum("a").over(w)), share(F.col("b"), F.sum("b").over(w))
    return cells.select(*groups, ((q - p) * F.ln(q / p)).alias("t")).groupBy(*groups).agg(F.sum("t").alias("psi"))


def _zero_to(least: float):
    return lambda n, total: F.when(n == 0, least).otherwise(n / total)


def _plus(least: float):
    return lambda n, total: n / total + least


def _sides(rows: DataFrame, groups: Sequence[str], base: Column, comparison: Column) -> DataFrame:
    return rows.groupBy(*groups, "bin").agg(F.count_if(base).alias("a"), F.count_if(comparison).alias("b"))


def _is(split: str, value: str) -> str:
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"{wide.quoted(split)} = '{text}'"


def _side(split: str, base: str, comparison: str) -> Column:
    return F.when(F.col(split) == base, 0).when(F.col(split) == comparison, 1)


def _pairs(bins: DataFrame) -> DataFrame:
    each = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0))
    return bins.groupBy("feature", "bin").agg(each(0).alias("a"), each(1).alias("b"))


def base_edges(df: DataFrame, features: Features, base: str = "train", n_bins: int = 10, split: str = "split") -> Edges:
    """The quantile edges of each column over the rows of one split."""
    return equal_freq_edges(df, {f: f"CASE WHEN {_is(split, base)} THEN {c} END" for f, c in wide.as_columns(features).items()}, n_bins)


def psi_numeric(df: DataFrame, features: Features, base: str = "train", comparison: str = "oot", n_bins: int = 10, split: str = "split", edges: Edges | None = None) -> DataFrame:
    """feature, psi: bins (a, b] of the base, missing is a bin, a share of zero is 1e-6. A column whose edges collapse is compared by value: those the base has, and all others.

    Some narrow scans of df, which should be a stored table; of columns that
    are compared by value, a task's distinct values move.
    """
    columns, side = wide.as_columns(features), _side(split, base, comparison)
    edges = base_edges(df, features, base, n_bins, split) if edges is None else edges
    flat = [f for f in columns if len(edges.get(f) or ()) <= 2]
    counts = wide.border_counts(df, columns, {f: [] if f in flat else wide.inner(edges[f]) for f in columns}, side, 2)
    counts = df.sparkSession.createDataFrame(counts.collect(), counts.schema)  # a row for each column and side
    binned_ = counts.filter(~F.col("feature").isin(flat))
    psi = psi_terms(_pairs(wide.bin_counts(binned_)), ["feature"], _zero_to(1e-6))
    if not flat:
        return psi
    sides = {(r.feature, r["class"]): (sum(r.codes), r.missing) for r in counts.filter(F.col("feature").isin(flat)).collect()}
    rows = [max([sum(v) for (_, k), v in sides.items() if k == s], default=0) for s in (0, 1)]
    share = lambda n, k: np.where(n == 0, 1e-6, n / max(rows[k], 1))

    def term(a, b):
        p, q = share(np.asarray(a, float), 0), share(np.asarray(b, float), 1)
        return float(((q - p) * np.log(q / p)).sum())

    def levels(values: np.ndarray, n: np.ndarray) -> dict:
        seen = n[:, 0] > 0
        return {"t": term(n[seen, 0], n[seen, 1]), "other": int(n[~seen, 1].sum())}

    parts = wide.value_counts(df, {f: columns[f] for f in flat}, levels, "t double, other long", sum(rows), side, 2)
    found = {r.feature: (r.t, r.other) for r in parts.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("other").alias("other")).collect()}
    out = []
    for f in flat:
        (t, other), (a, b) = found.get(f, (0.0, 0)), (sides.get((f, k), (0, 0))[1] for k in (0, 1))
        if a:
            t += term(a, b)
        else:
            other += b
        if other:
            t += term(0, other)
        if any((f, k) in sides for k in (0, 1)):
            out.append((f, t))
    return psi.unionByName(df.sparkSession.createDataFrame(out, "feature string, psi double"))


def feature_report(df: DataFrame, features: Features, label: str = "label", base: str = "train", comparison: str = "oot", n_bins: int = 10, split: str = "split") -> DataFrame:
    """quality_report of numeric columns: edges over all rows and over the base are sought in the same scans of df, which should be a stored table."""
    columns = wide.as_columns(features)
    both = {(f, k): f"CASE WHEN {_is(split, base)} THEN {c} END" if k else c for f, c in columns.items() for k in (0, 1)}
    about = wide.moments(df, both)
    edges = wide.edges_of(wide.quantiles(df, both, [k / n_bins for k in range(n_bins + 1)], about))
    iv = iv_of(woe_table(df, columns, label, edges={f: edges[f, 0] for f in columns}))
    psi = psi_numeric(df, columns, base, comparison, split=split, edges={f: edges[f, 1] for f in columns})
    known = [(f, 1 - about[f, 0]["n"] / about[f, 0]["rows"] if about[f, 0]["rows"] else None) for f in columns]
    return quality_report(iv, psi, df.sparkSession.createDataFrame(known, "feature string, missing_rate double"))


def psi_categorical(cats: DataFrame, base: str = "train", comparison: str = "oot") -> DataFrame:
    """feature, psi over the levels that the base has (null too), and one for all others. Levels are counted once; tasks add up theirs first."""
    counts = _sides(cats.filter(F.col("split").isin(base, comparison)).select("feature", "split", F.coalesce("value", F.lit("__null__")).alias("bin")), ["feature"], F.col("split") == base, F.col("split") == comparison)
    level = F.when(F.col("a") > 0, F.concat(F.lit("="), F.col("bin"))).otherwise("OTHER")
    cells = counts.groupBy("feature", level.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return psi_terms(cells, ["feature"], _zero_to(1e-6))


def drift_profile(long: DataFrame, pairs: DataFrame, n_bins: int = 10, least: int = 100) -> DataFrame:
    """kind, base, current, feature, psi for pairs (kind, base, current) of periods in long.period.

    Inner deciles of the base, bins [a, b); shares of non-null rows plus 1e-6,
    and the share of nulls as one more term. Periods under least rows are
    skipped; under ten values on a side psi is null.
    """
    sizes = long.groupBy("period", "feature").agg(F.count("*").alias("n"), F.count("value").alias("v")).groupBy("period").agg(F.max("n").alias("n")).filter(F.col("n") >= least).select("period")
    big = lambda c: sizes.select(F.col("period").alias(c))
    pairs = pairs.join(big("base"), "base").join(big("current"), "current").select("kind", "base", "current")
    used = pairs.select("base").distinct()
    edges = quantile_edges(long.join(F.broadcast(used.withColumnRenamed("base", "period")), "period"), n_bins, ["period", "feature"]).withColumnRenamed("period", "base")
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("base").alias("period")), F.struct(F.lit("b").alias("side"), F.col("current").alias("period")))).alias("s")).select("kind", "base", "current", "s.side", "s.period")
    rows = long.select("period", "feature", "value").join(F.broadcast(sides), "period").join(F.broadcast(edges), ["base", "feature"])
    at = F.when(F.col("value").isNull(), -1).otherwise(bin_index(F.col("value"), inner(F.col("edges")), "left"))
    keys = ["kind", "base", "current", "feature"]
    cells = rows.groupBy(*keys, at.alias("bin")).agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    w = Window.partitionBy(*keys)
    real = F.col("bin") >= 0
    value = lambda c: F.sum(F.when(real, F.col(c)).otherwise(0)).over(w)
    share = lambda c: F.when(real, F.col(c) / value(c)).otherwise(F.col(c) / F.sum(c).over(w)) + 1e-6
    p, q = share("a"), share("b")
    few = (value("a") < 10) | (value("b") < 10)
    terms = cells.select(*keys, F.when(~few, (q - p) * F.ln(q / p)).alias("t"))
    return terms.groupBy(*keys).agg(F.sum("t").alias("psi"))


def signed_label(value: Column, borders: Column) -> Column:
    """Missing, Negative, Zero or Positive_Qk by deciles of the positive values."""
    return F.when(value.isNull(), "Missing").when(value < 0, "Negative").when(value == 0, "Zero").otherwise(F.concat(F.lit("Positive_Q"), (bin_index(value, borders) + 1).cast("string")))


def signed_bins(long: DataFrame, fit: Column, n_bins: int = 10) -> DataFrame:
    """long with bin; the deciles come from the positive values of rows where fit holds."""
    edges = quantile_edges(long.filter(fit & (F.col("value") > 0)), n_bins)
    joined = long.join(F.broadcast(edges), "feature", "left")
    return joined.withColumn("bin", signed_label(F.col("value"), F.coalesce(inner(F.col("edges")), F.array().cast("array<double>")))).drop("edges")


def psi_signed(df: DataFrame, features: Features, base: str = "train", comparison: str = "oot", n_bins: int = 10, split: str = "split") -> DataFrame:
    """feature, psi, level over missing, negative, zero and the deciles of the base's positive values; 1e-6 is added to each share. Some narrow scans of df."""
    columns = wide.as_columns(features)
    edges = equal_freq_edges(df, {f: f"CASE WHEN {_is(split, base)} AND NOT isnan({c}) AND {c} > 0 THEN {c} END" for f, c in columns.items()}, n_bins)
    borders = {f: sorted({0.0, *wide.inner(edges[f])}) for f in columns}  # bin 0 is below zero; code 1 is zero itself
    counts = wide.border_counts(df, columns, borders, _side(split, base, comparison), 2)
    code = F.posexplode(F.concat("codes", F.array("missing"))).alias("code", "n")
    rows = counts.select("feature", "class", F.size("codes").alias("width"), code).filter("n > 0")
    label = F.when(F.col("code") == F.col("width"), "Missing").when(F.col("code") == 0, "Negative").when(F.col("code") == 1, "Zero").otherwise(F.concat(F.lit("Positive_Q"), F.floor(F.col("code") / 2).cast("string")))
    out = psi_terms(_pairs(rows.withColumn("bin", label)), ["feature"], _plus(1e-6))
    return out.withColumn("level", F.when(F.col("psi") > 0.25, "severe").when(F.col("psi") > 0.1, "warning").otherwise("ok"))


def psi_signed_categorical(cats: DataFrame, base: str = "train", comparison: str = "oot", k: int = 50) -> DataFrame:
    rows = cats.filter(F.col("split").isin(base, comparison))
    top = top_levels(rows.filter(F.col("split") == base), k).withColumn("__top", F.lit(True))
    cells = rows.join(F.broadcast(top), ["feature", "value"], "left").withColumn("bin", F.when(F.col("value").isNull(), "Missing").when(F.col("__top"), F.col("value")).otherwise("Other"))
    return psi_terms(_sides(cells, ["feature"], F.col("split") == base, F.col("split") == comparison), ["feature"], _plus(1e-6))


def monthly_psi(long: DataFrame, month: str, baseline: str | None = None, n_bins: int = 10) -> DataFrame:
    """feature, month, psi of each month against the baseline month (the earliest one)."""
    first = baseline or long.agg(F.min(month)).first()[0]
    rows = signed_bins(long.withColumnRenamed(month, "month"), F.col("month") == first, n_bins)
    counts = rows.groupBy("feature", "month", "bin").agg(F.count("*").alias("c"))
    base = counts.filter(F.col("month") == first).select("feature", "bin", F.col("c").alias("a"))
    months = counts.filter(F.col("month") != first).select("feature", "month").distinct()
    full = months.join(base, "feature").join(counts, ["feature", "month", "bin"], "left").select("feature", "month", "bin", "a", F.coalesce("c", F.lit(0)).alias("b"))
    new = counts.filter(F.col("month") != first).join(base, ["feature", "bin"], "left_anti").select("feature", "month", "bin", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    return psi_terms(full.unionByName(new), ["feature", "month"], _plus(1e-6))


def score_psi(df: DataFrame, score: str, base: str = "train", comparison: str = "oot", n_bins: int = 10) -> DataFrame:
    """One row: psi over bins [a, b) of the base's quantiles, the last one closed; shares clipped at 1e-12."""
    long = df.filter(F.col("split").isin(base, comparison)).select(F.lit("score").alias("feature"), F.col(score).alias("value"), "split").filter("value IS NOT NULL")
    cells = binned(long, quantile_edges(long.filter(F.col("split") == base), n_bins), "left")
    out = psi_terms(_sides(cells, ["feature"], F.col("split") == base, F.col("split") == comparison), ["feature"], lambda n, total: F.greatest(n / total, F.lit(1e-12)))
    return out.select("psi")


def token_drift(df: DataFrame, text: str, period: str, train: Column, top: int = 50, separators: str = "[,;| ]", base: float = 0.05, fall: float = 0.1) -> DataFrame:
    """period, token, coverage, base_coverage, ratio, collapsed.

    Tokens are cut at separators and named by what is before `@`; the top ones
    by coverage of training rows are followed. A token collapses in a period
    when its coverage is under fall of a base of at least base, after it was
    seen in an earlier period.
    """
    names = F.array_distinct(F.filter(F.transform(F.split(text, separators), lambda x: F.substring_index(x, "@", 1)), lambda x: x != ""))
    rows = df.filter(F.col(text).isNotNull()).select(F.col(period).alias("period"), names.alias("names"), train.alias("is_train"))
    n = rows.groupBy("period").agg(F.count("*").alias("n"), F.count_if("is_train").alias("n_train"))
    each = rows.select("period", "is_train", F.explode("names").alias("token")).groupBy("period", "token").agg(F.count("*").alias("c"), F.count_if("is_train").alias("c_train"))
    chosen = each.groupBy("token").agg(F.sum("c_train").alias("c_train")).filter("c_train > 0").orderBy(F.desc("c_train"), "token").limit(top)
    total = n.agg(F.sum("n_train").alias("all_train"))
    base_of = chosen.crossJoin(total).select("token", (F.col("c_train") / F.col("all_train")).alias("base_coverage"))  # at most top rows and one row
    grid = n.crossJoin(F.broadcast(base_of)).join(each, ["period", "token"], "left")  # periods and top tokens
    out = grid.select("period", "token", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("coverage"), "base_coverage")
    before = F.max("coverage").over(Window.partitionBy("token").orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("ratio", F.col("coverage") / F.col("base_coverage"))
    return out.withColumn("collapsed", (F.col("base_coverage") >= base) & (F.col("ratio") < fall) & (F.coalesce(before, F.lit(0.0)) > 0))


def token_divergence(df: DataFrame, text: str, period: str, train: Column, separators: str = "[,;| ]") -> DataFrame:
    """period, tokens_per_row, jsd (base 2, of token shares against training), new_share, vanished_share."""
    names = F.filter(F.transform(F.split(text, separators), lambda x: F.substring_index(x, "@", 1)), lambda x: x != "")
    rows = df.filter(F.col(text).isNotNull()).select(F.col(period).alias("period"), train.alias("is_train"), names.alias("names"))
    per_row = rows.groupBy("period").agg(F.avg(F.size("names")).alias("tokens_per_row"))
    each = rows.select("period", "is_train", F.explode("names").alias("token")).groupBy("period", "token").agg(F.count("*").alias("c"), F.count_if("is_train").alias("t"))
    base = each.groupBy("token").agg(F.sum("t").alias("t")).filter("t > 0")
    base = base.crossJoin(F.broadcast(base.agg(F.sum("t").alias("all_t")))).select("token", (F.col("t") / F.col("all_t")).alias("p"))  # one row
    totals = each.groupBy("period").agg(F.sum("c").alias("all_c"))
    now = each.join(totals, "period").select("period", "token", (F.col("c") / F.col("all_c")).alias("q"))
    # a training token that a period lacks adds half its share to the divergence: one minus the shares that were met
    both = now.join(base, "token", "left").select("period", F.coalesce("p", F.lit(0.0)).alias("p"), "q")
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0) / 2
    met = both.groupBy("period").agg(F.sum(half("p") + half("q")).alias("jsd"), F.sum(F.when(F.col("p") == 0, F.col("q")).otherwise(0.0)).alias("new_share"), F.sum("p").alias("met"))
    has = F.broadcast(base.agg((F.count(F.lit(1)) > 0).cast("double").alias("has")))  # one row
    gone = F.greatest(F.col("has") - F.coalesce("met", F.lit(0.0)), F.lit(0.0))
    out = totals.select("period").join(met, "period", "left").crossJoin(has).select("period", (F.coalesce("jsd", F.lit(0.0)) + gone / 2).alias("jsd"), F.coalesce("new_share", F.lit(0.0)).alias("new_share"), gone.alias("vanished_share"))
    return out.join(per_row, "period")


def ks_scan(long: DataFrame, side: Column, top: int = 30) -> DataFrame:
    """feature, ks, n_a, n_b: two-sample KS of each feature between rows where side is true and where it is false; the top ones."""
    counts = long.filter(F.col("value").isNotNull() & side.isNotNull()).groupBy("feature", "value").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    steps = prefix_sums(counts, ["value"], {"ca": F.col("a"), "cb": F.col("b")}, ["feature"], None)
    totals = counts.groupBy("feature").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(F.expr("try_divide(ca, n_a) - try_divide(cb, n_b)"))
    out = steps.join(F.broadcast(totals), "feature").groupBy("feature", "n_a", "n_b").agg(F.max(gap).alias("ks"))
    return out.select("feature", "ks", "n_a", "n_b").orderBy(F.desc("ks"), "feature").limit(top)
