"""Binning and predictive power: quantile edges, WoE, information value, univariate AUC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import wide
from plumbline.functions.primitives import bin_index, inner, quantile_edges

from .ranking import auc_of, average_ranks, correlation, score_counts

MISSING = -1
#: Names of columns, or names with an SQL expression for each.
Features = Sequence[str] | Mapping[str, str]
Edges = dict[str, list[float] | None]


def equal_freq_edges(df: DataFrame, features: Features, n_bins: int = 10) -> Edges:
    """Of each column the distinct linear quantiles, None without values; the outer ones stand for infinity. Some narrow scans of df, which should be a stored table."""
    return wide.edges_of(wide.quantiles(df, features, [k / n_bins for k in range(n_bins + 1)]))


def edge_table(spark: SparkSession, edges: Edges) -> DataFrame:
    """feature, edges."""
    return spark.createDataFrame(list(edges.items()), "feature string, edges array<double>")


def binned(long: DataFrame, edges: DataFrame, closed: str = "right", by: Sequence[str] = ("feature",)) -> DataFrame:
    """long with bin: its number by the edges of its feature (a small table), MISSING for null."""
    at = bin_index(F.col("value"), inner(F.col("edges")), closed)
    return long.join(F.broadcast(edges), list(by)).withColumn("bin", F.when(F.col("value").isNull(), MISSING).otherwise(at).cast("long")).drop("edges")


def woe_of(counts: DataFrame, smooth_total: float) -> DataFrame:
    """counts (feature, bin, pos, neg) with woe and iv parts: shares (n + 0.5) / (N + smooth_total). A feature has few bins."""
    w = Window.partitionBy("feature")
    p = (F.col("pos") + 0.5) / (F.sum("pos").over(w) + smooth_total)
    n = (F.col("neg") + 0.5) / (F.sum("neg").over(w) + smooth_total)
    two = (F.sum("pos").over(w) > 0) & (F.sum("neg").over(w) > 0)
    woe = F.when(two, F.ln(p / n))
    return counts.select("*", woe.alias("woe"), ((p - n) * woe).alias("iv_part"))


def label_counts(df: DataFrame, features: Features, edges: Edges, label: str = "label") -> DataFrame:
    """feature, bin, pos, neg: rows of both labels in right-closed bins, missing values in -1; one scan. Rows without a label are left out."""
    counts = wide.border_counts(df, features, {f: wide.inner(e) for f, e in edges.items()}, F.col(label).cast("int"), 2)
    each = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0))
    return wide.bin_counts(counts).groupBy("feature", "bin").agg(each(1).alias("pos"), each(0).alias("neg"))


def woe_table(df: DataFrame, features: Features, label: str = "label", n_bins: int = 10, edges: Edges | None = None) -> DataFrame:
    """feature, bin, pos, neg, woe, iv_part over right-closed bins of the quantiles (or of given edges) and a bin of missing values; columns without values have none."""
    edges = equal_freq_edges(df, features, n_bins) if edges is None else edges
    columns = {f: c for f, c in wide.as_columns(features).items() if edges.get(f) is not None}
    return woe_of(label_counts(df, columns, edges, label), 0.5) if columns else woe_of(df.sparkSession.createDataFrame([], "feature string, bin long, pos long, neg long"), 0.5)


def iv_of(table: DataFrame) -> DataFrame:
    """feature, iv, auc from a table of bins with pos, neg, woe and iv_part: the AUC of the woe as a score, folded to one half and more; null for a single class."""
    iv = table.groupBy("feature").agg(F.sum("iv_part").alias("iv"))
    scored = table.filter("woe IS NOT NULL").groupBy("feature", F.round("woe", 9).alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("feature").orderBy("score")) - F.col("neg")  # a row for each bin
    a = scored.withColumn("below", below).groupBy("feature").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    return iv.join(a, "feature", "left").select("feature", "iv", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def iv_table(df: DataFrame, features: Features, label: str = "label", n_bins: int = 10) -> DataFrame:
    """feature, iv, auc over the quantile bins of numeric columns."""
    return iv_of(woe_table(df, features, label, n_bins))


def top_levels(cats: DataFrame, k: int = 50, groups: Sequence[str] = ("feature",)) -> DataFrame:
    """groups, value: the k most frequent levels of each group, ties by name."""
    counts = cats.filter("value IS NOT NULL").groupBy(*groups, "value").agg(F.count("*").alias("c"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("c"), "value"))).filter(F.col("r") <= k).select(*groups, "value")


def category_bins(cats: DataFrame, k: int = 50) -> DataFrame:
    """cats with bin: the level, `__other__` beyond the k most frequent, `__nan__` for null."""
    top = top_levels(cats, k).withColumn("__top", F.lit(True))
    joined = cats.join(F.broadcast(top), ["feature", "value"], "left")  # k rows a feature
    return joined.withColumn("bin", F.when(F.col("value").isNull(), "__nan__").when(F.col("__top"), F.col("value")).otherwise("__other__")).drop("__top")


def mixed_bins(long: DataFrame, cats: DataFrame, n_bins: int = 10, k: int = 50) -> DataFrame:
    numeric = binned(long, quantile_edges(long, n_bins)).withColumn("bin", F.when(F.col("bin") == MISSING, "__nan__").otherwise(F.col("bin").cast("string")))
    return numeric.drop("value").unionByName(category_bins(cats, k).drop("value"))


def iv_woe_mixed(bins: DataFrame, label: str = "label") -> DataFrame:
    """feature, iv over numeric and categorical bins, shares (n + 0.5) / N."""
    counts = bins.groupBy("feature", "bin").agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return woe_of(counts, 0.0).groupBy("feature").agg(F.sum("iv_part").alias("iv"))


def uplift_iv(bins: DataFrame, label: str = "label", arm: str = "arm") -> DataFrame:
    """feature, iv_all, iv_treated, iv_control, gap: a large gap marks a moderator."""
    side = F.explode(F.array(F.lit("all"), F.when(F.col(arm) == 1, "treated").otherwise("control"))).alias("side")
    rows = bins.select(F.col("feature"), "bin", label, side).withColumn("feature", F.concat_ws("\t", "side", "feature"))
    iv = iv_woe_mixed(rows, label).select(F.split("feature", "\t")[0].alias("side"), F.split("feature", "\t")[1].alias("feature"), "iv")
    wide = iv.groupBy("feature").pivot("side", ["all", "treated", "control"]).agg(F.first("iv"))
    return wide.select("feature", F.col("all").alias("iv_all"), F.col("treated").alias("iv_treated"), F.col("control").alias("iv_control"), F.abs(F.col("treated") - F.col("control")).alias("gap"))


def target_spearman(long: DataFrame, target: str, least: int = 10) -> DataFrame:
    """feature, n, spearman: absolute rank correlation with the target over rows where the feature is not null; null under least rows."""
    rows = long.filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    x = average_ranks(rows).withColumnRenamed("rank", "rx")
    both = average_ranks(x, ["feature"], target)
    out = both.groupBy("feature").agg(F.count("*").alias("n"), F.abs(correlation("rx", "rank")).alias("r"))
    return out.select("feature", "n", F.when(F.col("n") >= least, F.col("r")).alias("spearman"))


def univariate_auc(long: DataFrame, label: str = "label", groups: Sequence[str] = ("feature",)) -> DataFrame:
    """feature, auc: max(a, 1 - a) of the raw value; null for one class or a constant."""
    counts = score_counts(long, label, "value", groups)
    varied = counts.groupBy(*groups).agg(F.count("*").alias("__levels"))
    out = auc_of(counts, groups).join(varied, list(groups))
    return out.select(*groups, F.when(F.col("__levels") > 1, F.greatest("auc", 1 - F.col("auc"))).alias("auc"))


def woe_encode(long: DataFrame, edges: DataFrame, woe: DataFrame) -> DataFrame:
    """long with woe: that of the value's bin, 0 for a bin that training had not."""
    cells = binned(long, edges)
    return cells.join(F.broadcast(woe.select("feature", "bin", "woe")), ["feature", "bin"], "left").withColumn("woe", F.coalesce("woe", F.lit(0.0)))


def best_segments(pos: np.ndarray, neg: np.ndarray, most: int, least_rows: float) -> list[int]:
    """Where to cut a row of bins so that event rates rise or fall strictly from segment to segment and the information value is largest.

    Ends of at most `most` segments of at least least_rows rows each, by dynamic
    programming over the last two cuts: exact. Without a cut that is
    allowed, all is one segment.
    """
    m = len(pos)
    p, n = np.append(0, np.cumsum(pos)).astype(float), np.append(0, np.cumsum(neg)).astype(float)
    ps, ns = p[None] - p[:, None], n[None] - n[:, None]  # [i, j]: of the bins from i up to j
    i, j = np.indices(ps.shape)
    fits = (j > i) & (ps + ns >= least_rows) & (ps + ns > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(ps + ns > 0, ps / (ps + ns), np.nan)
        a, b = (ps + 0.5) / (p[-1] + 0.5), (ns + 0.5) / (n[-1] + 0.5)
        value = np.where(fits, (a - b) * np.log(a / b), -np.inf)
    best, ends = -np.inf, [m]
    for sign in (1, -1):
        total = np.where(i == 0, value, -np.inf)  # with one segment
        came: list[np.ndarray] = []
        for k in range(most):
            if total[:, m].max() > best + 1e-12:
                best, at, path = total[:, m].max(), (int(total[:, m].argmax()), m), []
                for back in reversed(came):
                    path.append(at[1])
                    at = (int(back[at]), at[0])
                ends = [at[1], *reversed(path)]
            step, back = np.full_like(total, -np.inf), np.zeros(total.shape, np.int64)
            for c in range(1, m):  # the last segment begins at c; the one before it anywhere, if rates go on the same way
                allowed = sign * (rate[c, None, :] - rate[:, c, None]) > 0
                reach = np.where(allowed, total[:, c, None], -np.inf)
                back[c] = reach.argmax(0)
                step[c] = reach.max(0) + value[c]
            total = step
            came.append(back)
    return ends


def monotone_edges(df: DataFrame, features: Features, label: str = "label", most: int = 5, n_prebins: int = 50, least_share: float = 0.05) -> Edges:
    """Of each column the edges of at most `most` bins whose event rates rise or fall throughout, with the largest information value; None without values.

    Quantile bins are counted by label in one scan and joined by best_segments,
    a column at a time over many tasks; a bin has at least least_share of the
    rows with a value and a label. Outer edges stand for infinity.
    """
    edges = equal_freq_edges(df, features, n_prebins)
    columns = {f: c for f, c in wide.as_columns(features).items() if edges[f] is not None}
    if not columns:
        return edges
    counts = label_counts(df, columns, edges, label).filter("bin >= 0")

    def segments(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        pos, neg = rows["pos"].to_numpy(), rows["neg"].to_numpy()
        ends = best_segments(pos, neg, most, least_share * (pos.sum() + neg.sum()))
        return pd.DataFrame({"feature": rows["feature"].iloc[:1], "upto": [rows["bin"].to_numpy()[[e - 1 for e in ends[:-1]]].tolist()]})

    found = {r.feature: r.upto for r in counts.groupBy("feature").applyInPandas(segments, "feature string, upto array<long>").collect()}  # a row for each column
    return {f: e if e is None else [e[0], *[e[int(b) + 1] for b in found.get(f, [])], e[-1]] for f, e in edges.items()}


def level(c: Column, borders: Sequence[float], names: Sequence[str]) -> Column:
    """The last name whose border c reaches."""
    out = F.lit(names[0])
    for border, name in zip(borders, names[1:], strict=True):
        out = F.when(c >= border, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def quality_report(iv: DataFrame, psi: DataFrame, stats: DataFrame) -> DataFrame:
    """feature, iv, auc, psi, missing_rate, iv_level, psi_level, stable: outer join of the result tables."""
    out = stats.select("feature", "missing_rate").join(iv, "feature", "outer").join(psi.select("feature", "psi"), "feature", "outer")
    return out.withColumns({
        "iv_level": level(F.col("iv"), (0.02, 0.1, 0.3, 0.5), ("none", "weak", "medium", "strong", "suspicious")),
        "psi_level": level(F.col("psi"), (0.02, 0.1, 0.25), ("none", "low", "moderate", "high")),
        "stable": F.coalesce(F.col("psi") < 0.1, F.lit(False)),
    })
