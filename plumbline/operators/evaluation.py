"""Evaluation of classification and regression scores: bins by global rank, segments, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plumbline.functions.primitives import global_rank, quantile_edges, quantiles, spread, written

from .ranking import auc, ks


def _all() -> WindowSpec:
    """Only for tables of a row for each bin, segment or candidate."""
    return Window.partitionBy()


def ranked(df: DataFrame, score: str, key: str, falling: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """df (null scores left out) with rank and total, in order of (score, key)."""
    rows = df.filter(F.col(score).isNotNull())
    out = global_rank(rows, [f"-{score}" if falling else score, key], groups)
    totals = rows.groupBy(*groups).agg(F.count("*").alias("total"))
    return out.join(totals, list(groups)) if groups else out.crossJoin(F.broadcast(totals))  # one row


def log_loss(label: str, score: str, clip: float = 1e-9) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    return -F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))


def logloss_gini(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: logloss, gini."""
    loss = df.filter(F.col(score).isNotNull()).agg(F.avg(log_loss(label, score)).alias("logloss"))
    return loss.crossJoin(auc(df, label, score).select((2 * F.col("auc") - 1).alias("gini")))  # one row each


def threshold_metrics(df: DataFrame, label: str, score: str, t: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1; null where a denominator is zero."""
    y, s = F.col(label) == 1, F.col(score) >= t
    cells = df.agg(F.count_if(y & s).alias("tp"), F.count_if(~y & s).alias("fp"), F.count_if(y & ~s).alias("fn"), F.count_if(~y & ~s).alias("tn"))
    e = F.expr
    return cells.withColumns({"accuracy": e("try_divide(tp + tn, tp + fp + fn + tn)"), "precision": e("try_divide(tp, tp + fp)"), "recall": e("try_divide(tp, tp + fn)"), "f1": e("try_divide(2 * tp, 2 * tp + fp + fn)")})


def _cumulative(order: str, falling: bool = False):
    return Window.orderBy(F.desc(order) if falling else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)  # over a row for each bin


def decile_table(df: DataFrame, score: str, label: str, key: str, n: int = 10, business: Sequence[str] = ()) -> DataFrame:
    """decile (n is best), rows, score range, rate, lift, recall, cum_recall, business means; equal-width cut of the falling row number."""
    rows = ranked(df, score, key)
    bin_ = F.greatest(F.ceil(F.col("rank") * n / F.greatest(F.col("total") - 1, F.lit(1))) - 1, F.lit(0))
    each = rows.groupBy((n - bin_).cast("long").alias("decile")).agg(
        F.count("*").alias("rows"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.sum(label).alias("positives"), F.avg(label).alias("rate"), *[F.avg(b).alias(f"avg_{b}") for b in business]
    )
    out = each.withColumn("lift", F.col("rate") / F.nullif(F.sum("positives").over(_all()) / F.sum("rows").over(_all()), F.lit(0)))
    return out.withColumn("recall", F.col("positives") / F.nullif(F.sum("positives").over(_all()), F.lit(0))).withColumn("cum_recall", F.sum("recall").over(_cumulative("decile", True)))


def score_bucket(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """df with bucket: floor(rank * n / total) + 1, 1 for the highest scores."""
    return ranked(df, score, key).withColumn("bucket", (F.floor(F.col("rank") * n / F.col("total")) + 1).cast("long")).drop("rank", "total")


def with_segments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row once for `all` and once for its value of each column; columns are not crossed, null is a value."""
    names = [F.lit("all")] + [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]
    return df.select("*", F.explode(F.array(*names)).alias("segment"))


def segment_metrics(df: DataFrame, label: str, score: str, columns: Sequence[str], least: int = 10, least_ks: int = 50) -> DataFrame:
    """segment, rows, rate, auc, ks; null under least rows, ks only above least_ks."""
    rows = with_segments(df, columns)
    base = rows.groupBy("segment").agg(F.count("*").alias("rows"), F.avg(label).alias("rate"))
    out = base.join(auc(rows, label, score, ["segment"]), "segment", "left").join(ks(rows, label, score, ["segment"]), "segment", "left")
    return out.select("segment", "rows", "rate", F.when(F.col("rows") >= least, F.col("auc")).alias("auc"), F.when((F.col("rows") > least_ks) & F.col("auc").isNotNull(), F.col("ks")).alias("ks"))


def slice_masks(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: int = 8, least: int = 50) -> DataFrame:
    """df's rows with slice (column=quartile or column=level); the top levels only, slices under least rows dropped."""
    from plumbline.functions.primitives import bin_index, inner

    out = df
    parts = []
    for c in numeric:
        edges = quantile_edges(df.select(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")), 4).select(F.col("edges").alias(f"__e_{c}"))
        out = out.crossJoin(F.broadcast(edges))  # one row
        parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}=q"), (bin_index(F.col(c).cast("double"), inner(F.col(f"__e_{c}"))) + 1).cast("string"))))
    for c in categorical:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), c).limit(most).select(c, F.lit(True).alias(f"__t_{c}"))
        out = out.join(F.broadcast(top), c, "left")  # at most `most` rows
        parts.append(F.when(F.col(f"__t_{c}"), F.concat(F.lit(f"{c}="), F.col(c))))
    rows = out.select(*df.columns, F.explode(F.array_compact(F.array(*parts))).alias("slice"))
    big = rows.groupBy("slice").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select("slice")
    return rows.join(F.broadcast(big), "slice")  # a row for each slice


def top_lift(df: DataFrame, label: str, score: str, key: str, pct: float) -> DataFrame:
    """One row: rows of the top share (one at least, rounded half to even), their rate over the overall rate."""
    rows = ranked(df, score, key).withColumn("__top", F.col("rank") < F.greatest(F.lit(1), F.bround(F.col("total") * pct / 100)))
    return rows.agg(F.count_if("__top").alias("rows"), (F.avg(F.when(F.col("__top"), F.col(label))) / F.nullif(F.avg(label), F.lit(0.0))).alias("lift"))


def rank_bins(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """df with bin int(i * n / N) in rising order, 0 to n - 1; no rows if there are under 10 n rows or n distinct scores."""
    enough = df.agg((F.count(score) >= 10 * n) & (F.count_distinct(score) >= n)).first()[0]
    rows = ranked(df if enough else df.limit(0), score, key, falling=False)
    return rows.withColumn("bin", F.floor(F.col("rank") * n / F.col("total")).cast("long"))


def segment_ranking(df: DataFrame, score: str, target: str, key: str, n: int = 10) -> DataFrame:
    """One row: bins, monotonicity (share of rising steps), spearman of bin and mean, top_lift, passed (0.8 and rising)."""
    bins = rank_bins(df, score, key, n).groupBy("bin").agg(F.avg(target).alias("m"), F.count("*").alias("c"))
    step = F.col("m") >= F.lag("m").over(Window.orderBy("bin"))
    bins = bins.withColumn("up", step.cast("double")).withColumn("r", F.rank().over(Window.orderBy("m"))).withColumn("all_mean", F.sum(F.col("m") * F.col("c")).over(_all()) / F.sum("c").over(_all()))
    out = bins.agg(F.count("*").alias("bins"), F.avg("up").alias("monotonicity"), F.corr(F.col("bin").cast("double"), F.col("r").cast("double")).alias("rho"), F.max_by(F.col("m") / F.nullif(F.col("all_mean"), F.lit(0.0)), "bin").alias("top_lift"))
    return out.select("bins", "monotonicity", F.abs("rho").alias("spearman"), "top_lift", ((F.col("monotonicity") >= 0.8) & (F.col("rho") > 0)).alias("passed"))


def classification_segments(df: DataFrame, label: str, score: str, key: str, n: int = 10) -> DataFrame:
    """bin (n - 1 is best), rows, share, positives, rate, lift, and cumulative rate, lift, recall and KS from the best on."""
    each = rank_bins(df, score, key, n).groupBy("bin").agg(F.count("*").alias("rows"), F.sum(label).alias("positives"))
    down = _cumulative("bin", True)
    rows, pos = F.sum("rows").over(_all()), F.sum("positives").over(_all())
    cr, cp = F.sum("rows").over(down), F.sum("positives").over(down)
    return each.select(
        "bin", "rows", (F.col("rows") / rows).alias("share"), "positives", (F.col("positives") / F.col("rows")).alias("rate"), (F.col("positives") / F.col("rows") / F.nullif(pos / rows, F.lit(0))).alias("lift"),
        (cp / cr).alias("cum_rate"), (cp / cr / F.nullif(pos / rows, F.lit(0))).alias("cum_lift"), (cp / F.nullif(pos, F.lit(0))).alias("cum_recall"), F.abs(cp / F.nullif(pos, F.lit(0)) - (cr - cp) / F.nullif(rows - pos, F.lit(0))).alias("ks"),
    )


def merge_evaluations(evals: DataFrame, metrics: Sequence[str], by: Sequence[str], weight: str = "rows") -> DataFrame:
    """by, weight's sum, and each metric's mean by weight over the parts that have it."""
    means = [(F.sum(F.col(m) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), F.col(weight))), F.lit(0))).alias(m) for m in metrics]
    return evals.groupBy(*by).agg(F.sum(weight).alias(weight), *means)


def compare_models(evals: DataFrame, models: Sequence[str]) -> DataFrame:
    """segment and, for each model, its auc and ks side by side."""
    return evals.groupBy("segment").pivot("model", list(models)).agg(F.first("auc").alias("auc"), F.first("ks").alias("ks"))


def cut_bins(rank: Column, total: Column, n: int) -> Column:
    """The number of borders int(j * N / n), j from 1, up to rank."""
    return sum(((rank >= F.floor(total * j / n)).cast("long") for j in range(1, n)), F.lit(0).cast("long"))


def error_bins(df: DataFrame, label: str, score: str, key: str, n: int = 10) -> DataFrame:
    """bin (0 is the highest scores), rows, mean_score, rate, loss_share, loss_over_share, bias."""
    rows = ranked(df, score, key).withColumn("__loss", log_loss(label, score)).withColumn("bin", cut_bins(F.col("rank"), F.col("total"), n))
    each = rows.groupBy("bin").agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"), F.sum("__loss").alias("loss"))
    share = F.col("loss") / F.sum("loss").over(_all())
    return each.select("bin", "rows", "mean_score", "rate", share.alias("loss_share"), (share / (F.col("rows") / F.sum("rows").over(_all()))).alias("loss_over_share"), (F.col("mean_score") - F.col("rate")).alias("bias"))


def high_loss_profile(df: DataFrame, label: str, score: str, key: str, features: Sequence[str], share: float = 0.05, least: int = 30, z_min: float = 0.1, top: int = 20) -> DataFrame:
    """feature, mean_high, mean_rest, z: features that differ between the highest losses and the rest, by the rest's deviation."""
    from plumbline.functions.primitives import melt

    rows = ranked(df.withColumn("__loss", log_loss(label, score)), "__loss", key)
    rows = rows.withColumn("__high", F.col("rank") < F.greatest(F.lit(least), F.floor(F.col("total") * share)))
    v, high = F.col("value"), F.col("__high")
    each = melt(rows, features, ["__high"]).groupBy("feature").agg(F.avg(F.when(high, v)).alias("mean_high"), F.avg(F.when(~high, v)).alias("mean_rest"), F.stddev_samp(F.when(~high, v)).alias("sd"))
    out = each.withColumn("z", (F.col("mean_high") - F.col("mean_rest")) / F.when(F.col("sd") > 1e-12, F.col("sd")))
    return out.filter(F.abs("z") > z_min).orderBy(F.desc(F.abs("z")), "feature").limit(top).select("feature", "mean_high", "mean_rest", "z")


def delta_by_bin(df: DataFrame, label: str, new: str, old: str, key: str, n: int = 10) -> DataFrame:
    """bin of the new score, rows, mean loss that the new score saves over the old one."""
    rows = ranked(df, new, key).withColumn("bin", cut_bins(F.col("rank"), F.col("total"), n))
    return rows.groupBy("bin").agg(F.count("*").alias("rows"), F.avg(log_loss(label, old) - log_loss(label, new)).alias("saved"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: rmse, mae, mape (over targets that aren't zero), r2."""
    e, t = F.col(p) - F.col(y), F.col(y)
    return df.filter(t.isNotNull() & F.col(p).isNotNull()).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(t != 0, F.abs(e / F.nullif(t, F.lit(0.0))))).alias("mape"), (1 - F.avg(e * e) / F.nullif(spread(F.var_pop, t), F.lit(0.0))).alias("r2")
    )


def regression_segments(df: DataFrame, y: str, p: str, key: str, n: int = 10) -> DataFrame:
    """bin by prediction, rows, means, bias, mae, rmse, median, range, total, share and cumulative share of the target from the highest bin on."""
    e = F.col(p) - F.col(y)
    rows = written(rank_bins(df, p, key, n).select("bin", p, y), "bins")
    each = rows.groupBy("bin").agg(
        F.count("*").alias("rows"), F.avg(p).alias("mean_pred"), F.avg(y).alias("mean_actual"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.min(p).alias("min_pred"), F.max(p).alias("max_pred"), F.sum(y).alias("total"),
    )
    each = each.join(F.broadcast(quantiles(rows, (0.5,), ["bin"], y)), "bin").withColumn("median", F.col("q")[0]).drop("q")
    return each.withColumn("share", F.col("total") / F.nullif(F.sum("total").over(_all()), F.lit(0.0))).withColumn("cum_share", F.sum("share").over(_cumulative("bin", True)))


def level_stats(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), least: int = 1, tolerance: float = 0.1, z: float = 2.0) -> DataFrame:
    """groups, rows, ratio of mean prediction to mean actual, its delta-method standard error, warning."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    means = rows.groupBy(*groups).agg(F.count("*").alias("rows"), (F.avg(p) / F.nullif(F.avg(y), F.lit(0.0))).alias("ratio"), F.avg(y).alias("__y")).filter(F.col("rows") >= least)
    joined = rows.join(means, list(groups)) if groups else rows.crossJoin(F.broadcast(means))  # one row
    spread = joined.groupBy(*groups, "rows", "ratio", "__y").agg(F.stddev_samp(F.col(p) - F.col("ratio") * F.col(y)).alias("sd"))
    out = spread.withColumn("se", F.col("sd") / (F.sqrt("rows") * F.abs(F.nullif("__y", F.lit(0.0)))))
    return out.select(*groups, "rows", "ratio", "se", (F.abs(F.col("ratio") - 1) > F.greatest(F.lit(tolerance), z * F.col("se"))).alias("warning"))


def metric_divergence(df: DataFrame, y: str, new: str, old: str, z: float = 2.0) -> DataFrame:
    """One row: change of squared and of absolute error from old to new, their paired errors, diverged (opposite ways, both beyond z errors)."""
    a, b = F.col(new) - F.col(y), F.col(old) - F.col(y)
    sq, ab = a * a - b * b, F.abs(a) - F.abs(b)
    out = df.agg(F.avg(sq).alias("d_squared"), (F.stddev_samp(sq) / F.sqrt(F.count(sq))).alias("se_squared"), F.avg(ab).alias("d_absolute"), (F.stddev_samp(ab) / F.sqrt(F.count(ab))).alias("se_absolute"))
    far = (F.abs("d_squared") > z * F.col("se_squared")) & (F.abs("d_absolute") > z * F.col("se_absolute"))
    return out.withColumn("diverged", far & (F.signum("d_squared") != F.signum("d_absolute")))
