"""Profiles and audits of a sample."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import wide
from plumbline.functions.primitives import melt


def _distinct(values: np.ndarray, counts: np.ndarray) -> dict:
    return {"distinct": len(values), "top": int(counts.sum(1).max(initial=0))}


def distinct_values(df: DataFrame, features: Sequence[str], rows: int) -> DataFrame:
    """feature, distinct, top (rows of the most frequent value) of the values that are there."""
    parts = wide.value_counts(df, features, _distinct, "distinct long, top long", rows)
    return parts.groupBy("feature").agg(F.sum("distinct").alias("distinct"), F.max("top").alias("top"))


def basic_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, dtype, n, missing_rate, distinct, mean, std, min, q25, median, q75, max; an absent column has dtype MISSING_COL. Text columns have no moments.

    Numeric columns are read by some narrow scans, so df should be a stored
    table; a task's distinct values are all that moves.
    """
    kinds = dict(df.dtypes)
    here = [f for f in features if f in kinds]
    text = [f for f in here if kinds[f] in ("string", "boolean", "date", "timestamp")]
    numeric = [f for f in here if f not in text]
    v, spark = F.col("value"), df.sparkSession
    shape = "feature string, dtype string, n long, missing_rate double, mean double, std double, min double, q25 double, median double, q75 double, max double"
    about = wide.moments(df, numeric) if numeric else {}
    quarters = wide.quantiles(df, numeric, (0.25, 0.5, 0.75), about) if numeric else {}
    known = []
    for f in features:
        m = about.get(f)
        if m is None:
            known.append((f, kinds.get(f, "MISSING_COL"), *[None] * 9))
            continue
        n, rows = m["n"], m["rows"]
        std = None if not n else 0.0 if n == 1 else math.sqrt(m["m2"] / (n - 1))
        known.append((f, kinds[f], n, 1 - n / rows if rows else None, m["mean"], std, m["min"], *(quarters[f] or [None] * 3), m["max"]))
    named = spark.createDataFrame(known, shape)
    parts = [distinct_values(df, numeric, max([m["rows"] for m in about.values()], default=0)).select("feature", F.lit(None).cast("long").alias("n2"), F.lit(None).cast("double").alias("rate2"), "distinct")] if numeric else []
    if text:
        parts.append(melt(df, text, text=True).groupBy("feature").agg(F.count(v).alias("n2"), F.expr("1 - count(value) / count(*)").alias("rate2"), F.count_distinct(v).alias("distinct")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], "feature string, n2 long, rate2 double, distinct long")
    none = F.when(F.col("dtype") != "MISSING_COL", 0)
    return F.broadcast(named).join(found, "feature", "left").select(
        "feature", "dtype", F.coalesce("n", "n2").alias("n"), F.coalesce("missing_rate", "rate2").alias("missing_rate"), F.coalesce("distinct", none).cast("long").alias("distinct"),
        "mean", "std", "min", "q25", "median", "q75", "max",
    )


def feature_quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, coverage, distinct_ratio, outlier_share, is_constant, top_share, high_cardinality of numeric columns; some narrow scans of df."""
    about = wide.moments(df, features)
    ends = wide.quantiles(df, features, (0.01, 0.99), about)
    bounds = {f: sorted({q[0] - 3 * (q[1] - q[0]), q[1] + 3 * (q[1] - q[0])}) for f, q in ends.items() if q}
    beyond = {r.feature: r.codes[0] + r.codes[2 * len(bounds[r.feature])] for r in wide.border_counts(df, list(bounds), bounds).collect()} if bounds else {}  # a row for each column
    known = df.sparkSession.createDataFrame([(f, m["rows"], m["n"], beyond.get(f, 0)) for f, m in about.items()], "feature string, rows long, n long, out long")
    found = distinct_values(df, features, max(m["rows"] for m in about.values()))
    base = F.broadcast(known).join(found, "feature", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    ratio = F.expr("try_divide(distinct, n)")
    return base.select(
        "feature", F.expr("try_divide(n, rows)").alias("coverage"), ratio.alias("distinct_ratio"), F.expr("try_divide(out, n)").alias("outlier_share"),
        (F.col("distinct") <= 1).alias("is_constant"), F.expr("try_divide(top, n)").alias("top_share"), ((ratio > 0.95) & (F.col("distinct") > 100)).alias("high_cardinality"),
    )


def quality_by_split(long: DataFrame) -> DataFrame:
    """split, feature, missing, missing_rate, distinct, mode_ratio, severity: severe, warning or ok."""
    counts = long.groupBy("split", "feature", "value").agg(F.count("*").alias("c"))
    v, c = F.col("value"), F.col("c")
    each = counts.groupBy("split", "feature").agg(F.sum(c).alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), c)), F.lit(0)).alias("missing"), F.count(v).alias("distinct"), F.max(F.when(v.isNotNull(), c)).alias("top"))
    each = each.withColumn("missing_rate", F.col("missing") / F.col("rows")).withColumn("mode_ratio", F.expr("try_divide(top, rows - missing)"))
    severe = (F.col("missing_rate") > 0.8) | (F.col("distinct") <= 1) | (F.col("mode_ratio") >= 0.99)
    warning = (F.col("missing_rate") > 0.5) | (F.col("mode_ratio") >= 0.95)
    return each.select("split", "feature", "missing", "missing_rate", "distinct", "mode_ratio", F.when(severe, "severe").when(warning, "warning").otherwise("ok").alias("severity"))


def identifier_like(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, unique_ratio, one_length (share of the most frequent length), token_share, named, identifier. Fractional numbers never are."""
    kinds = dict(df.dtypes)
    whole = [c for c in cols if kinds[c] not in ("double", "float")]
    long = melt(df, whole, text=True).filter("value IS NOT NULL")
    lengths = long.groupBy("feature", F.length("value").alias("l")).agg(F.count("*").alias("c")).groupBy("feature").agg(F.max("c").alias("same"), F.sum("c").alias("n"))
    rest = long.groupBy("feature").agg(F.count_distinct("value").alias("d"), F.avg(F.col("value").rlike("^[A-Za-z0-9_-]{6,}$").cast("double")).alias("token_share"))
    out = lengths.join(rest, "feature").select("feature", (F.col("d") / F.col("n")).alias("unique_ratio"), (F.col("same") / F.col("n")).alias("one_length"), "token_share", F.col("feature").rlike("(^|_)(id|key|no|uuid)$").alias("named"))
    return out.withColumn("identifier", (F.col("unique_ratio") > 0.95) & (F.col("named") | (F.col("one_length") >= 0.8) | (F.col("token_share") >= 0.9)))


def text_shape(df: DataFrame, col: str, separators: str = "[,;| ]") -> DataFrame:
    """One row: length variation, delimiters a row, vocabulary, token reuse, composite (the text is a list, not a name)."""
    text = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("t"))
    shape = text.agg((F.stddev_samp(F.length("t")) / F.avg(F.length("t"))).alias("length_cv"), F.avg(F.regexp_count("t", F.lit(separators))).alias("delimiters"))
    words = text.select(F.explode(F.split("t", separators)).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    vocabulary = words.agg(F.count("*").alias("vocabulary"), (F.sum("c") / F.count("*")).alias("reuse"))
    both = shape.crossJoin(vocabulary)  # one row each
    return both.withColumn("composite", (F.col("length_cv") > 0.25) | (F.col("reuse") > 50) | (F.col("delimiters") > 0.5))


def sample_distribution(df: DataFrame, dt: str, label: str, entity: str, arm: str) -> DataFrame:
    """month, rows, rate, entities, duplicate_rate (rows beyond one an entity), treated_rate, treated_response, control_response, ate."""
    y, t = F.col(label), F.col(arm)
    each = df.groupBy(F.date_format(dt, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("rows"), F.avg(y).alias("rate"), F.count_distinct(entity).alias("entities"), F.avg(t).alias("treated_rate"),
        F.avg(F.when(t == 1, y)).alias("treated_response"), F.avg(F.when(t == 0, y)).alias("control_response"),
    )
    return each.withColumn("duplicate_rate", 1 - F.col("entities") / F.col("rows")).withColumn("ate", F.col("treated_response") - F.col("control_response"))


def sample_overview(df: DataFrame, id_: str, dt: str, label: str) -> DataFrame:
    """One row: rows, positives, negatives, ratio, first and last day, null labels, distinct ids, rows that repeat an (id, dt)."""
    y = F.col(label)
    keys = df.groupBy(id_, dt).agg(F.count("*").alias("c"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"), F.count_if(y.isNull()).alias("z"))
    out = keys.agg(F.sum("c").alias("rows"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.min(dt).cast("string").alias("first_day"), F.max(dt).cast("string").alias("last_day"), F.sum("z").alias("null_labels"), F.count_distinct(id_).alias("ids"), F.sum(F.col("c") - 1).alias("repeated"))
    return out.withColumn("ratio", F.expr("try_divide(negatives, positives)"))


def label_stability(df: DataFrame, dt: str, label: str) -> DataFrame:
    """One row: periods (days up to ten, else months), range and deviation of their rates in points, verdict, sufficiency."""
    days = df.select(F.count_distinct(dt).alias("days"))
    rows = df.crossJoin(F.broadcast(days))  # one row
    period = F.when(F.col("days") <= 10, F.date_format(dt, "yyyy-MM-dd")).otherwise(F.date_format(dt, "yyyy-MM"))
    each = rows.groupBy(period.alias("period")).agg(F.avg(label).alias("r"), F.count("*").alias("n"), F.sum(label).alias("p"))
    out = each.agg(F.count("*").alias("periods"), ((F.max("r") - F.min("r")) * 100).alias("range_points"), (F.stddev_pop("r") * 100).alias("std_points"), F.sum("n").alias("rows"), F.sum("p").alias("positives"))
    verdict = F.when(F.col("std_points") < 1, "stable").when(F.col("std_points") < 3, "slight").otherwise("marked")
    enough = F.when((F.col("rows") >= 10_000) & (F.col("positives") >= 500), "sufficient").when((F.col("rows") >= 1_000) & (F.col("positives") >= 50), "limited").otherwise("insufficient")
    return out.withColumn("verdict", verdict).withColumn("sufficiency", enough)


def entity_overlap(df: DataFrame, entity: str, split: str = "split", names: Sequence[str] = ("train", "test", "oot")) -> DataFrame:
    """left, right, both, either, jaccard of the entity sets of each two splits, from one bit mask an entity."""
    mask = F.bit_or(sum((F.when(F.col(split) == s, 1 << k).otherwise(0) for k, s in enumerate(names)), F.lit(0)))
    counts = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(mask.alias("m")).groupBy("m").agg(F.count("*").alias("c"))
    pairs = [(a, b, 1 << i, 1 << j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    table = df.sparkSession.createDataFrame(pairs, "left string, right string, a int, b int")
    met = counts.crossJoin(F.broadcast(table))  # at most 2 ** splits rows with a few pairs
    has = lambda x: F.col("m").bitwiseAND(F.col(x)) > 0
    out = met.groupBy("left", "right").agg(F.sum(F.when(has("a") & has("b"), F.col("c")).otherwise(0)).alias("both"), F.sum(F.when(has("a") | has("b"), F.col("c")).otherwise(0)).alias("either"))
    return out.withColumn("jaccard", F.expr("try_divide(both, either)"))


def compression_audit(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """One row: rows an entity, share of (entity, column) without change among entities of several rows, and both signals."""
    levels = [F.count_distinct(F.col(c)).alias(c) for c in cols]
    each = df.groupBy(entity).agg(F.count("*").alias("n"), *levels)
    still = sum(((F.col(c) <= 1).cast("int") for c in cols), F.lit(0)) / len(cols)
    out = each.agg(F.avg("n").alias("rows_per_entity"), F.avg(F.when(F.col("n") > 1, still)).alias("unchanged_share"))
    return out.withColumn("many_periods", F.col("rows_per_entity") > 1.3).withColumn("compressible", F.col("unchanged_share") > 0.7)


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """bin, n, share: ten bins of width 0.1 on [0, 1], the last one closed."""
    each = df.filter(F.col(score).between(0, 1)).groupBy(F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def band(c: Column, borders: Sequence[float], names: Sequence[str]) -> Column:
    """The first name whose border is not passed; null stays null."""
    out = F.lit(names[-1])
    for border, name in reversed(list(zip(borders, names, strict=False))):
        out = F.when(c <= border, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def quality_summary(quality: DataFrame, psi: DataFrame) -> DataFrame:
    """kind, band, n: features by severity, by missing rate and by PSI."""
    parts = [
        quality.select(F.lit("severity").alias("kind"), F.col("severity").alias("band")),
        quality.select(F.lit("missing"), band(F.col("missing_rate"), (0.5, 0.8), ("low", "high", "severe"))),
        psi.filter("psi IS NOT NULL").select(F.lit("psi"), band(F.col("psi"), (0.1, 0.25), ("stable", "moderate", "strong"))),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "band").agg(F.count("*").alias("n"))


def profile_rules(stats: DataFrame, psi: DataFrame, rows: int, rate: float) -> DataFrame:
    """rule, subject: imbalance, small sample, strong drift (a column over 0.25), informative or heavy missing (over half)."""
    spark = stats.sparkSession
    whole = [("imbalance", "label")] * (min(rate, 1 - rate) < 0.05) + [("small_sample", "rows")] * (rows < 20_000)
    flags = spark.createDataFrame(whole, "rule string, subject string")
    drift = psi.filter("psi > 0.25").select(F.lit("strong_drift").alias("rule"), F.col("feature").alias("subject"))
    missing = stats.filter("missing_rate > 0.5").select(F.lit("missing").alias("rule"), F.col("feature").alias("subject"))
    high = stats.filter("distinct > 50 AND dtype = 'string'").select(F.lit("high_cardinality").alias("rule"), F.col("feature").alias("subject"))
    return flags.unionByName(drift).unionByName(missing).unionByName(high)
