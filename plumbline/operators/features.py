"""Feature construction: imputation, encodings, views, histories, group statistics, vectorised user functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.primitives import bin_index, inner, md5_number, melt, prefix_sums, quantile_edges, quantiles

from .ranking import auc


def medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, median (0 without values), missing_rate of the training rows."""
    v = F.col("value")
    long = melt(train, cols)
    rates = long.groupBy("feature").agg(F.avg(v.isNull().cast("double")).alias("missing_rate"))
    return rates.join(F.broadcast(quantiles(long, (0.5,))), "feature").select("feature", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("median"), "missing_rate")


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str], band: tuple[float, float] = (0.05, 0.80)) -> DataFrame:
    """df with training medians for nulls, and c_missing for columns whose training missing rate is in the band."""
    fitted = {r.feature: r for r in medians(train, cols).collect()}  # a row for each column
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in cols if band[0] <= fitted[c].missing_rate <= band[1]}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fitted[c].median)) for c in cols})


def encode_features(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most_levels: int = 200) -> DataFrame:
    """df with medians for numeric columns and a 0/1 column for each training level, MISSING and OTHER."""
    out = impute_median(train, df, numeric, (2.0, 2.0)) if numeric else df
    for c in categorical:
        levels = [r[0] for r in train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(most_levels).collect()]
        value = F.col(c)
        made = {f"{c}__{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in levels}
        made |= {f"{c}__MISSING": value.isNull().cast("int"), f"{c}__OTHER": F.coalesce((~value.isin(levels)).cast("int"), F.lit(0))}
        out = out.withColumns(made)
    return out


def recency_view(df: DataFrame, t: str, cols: Sequence[str], half_life: float, protect: Sequence[str]) -> DataFrame:
    """df with c_rec: c decayed by the days up to the last day of its split. Protected columns (target, ids, arm) are never weighted."""
    if not protect:
        raise ValueError("name the columns to protect")
    if clash := set(cols) & set(protect):
        raise ValueError(f"protected: {sorted(clash)}")
    last = df.groupBy("split").agg(F.max(t).alias("__last"))
    rows = df.join(F.broadcast(last), "split")  # a row for each split
    weight = F.exp(-math.log(2) * F.datediff("__last", t) / half_life)
    return rows.withColumns({f"{c}_rec": F.col(c) * weight for c in cols}).drop("__last")


def active_view(df: DataFrame, cols: Sequence[str], active: str) -> DataFrame:
    on = (F.coalesce(F.col(active), F.lit(0)) > 0).cast("int")
    return df.withColumns({f"{c}_active": F.col(c) * on for c in cols} | {"is_active": on})


def window_ratio_view(df: DataFrame) -> DataFrame:
    """df with the ratio of each shorter window column (x_1m, x_3m, x_6m, x_12m) to the next longer one; 0 for a zero denominator."""
    out = {}
    for c in df.columns:
        if not c.endswith("_1m") and not c.endswith("_3m") and not c.endswith("_6m"):
            continue
        stem, near = c.rsplit("_", 1)
        for far in ("3m", "6m", "12m"):
            if int(far[:-1]) > int(near[:-1]) and f"{stem}_{far}" in df.columns:
                out[f"{stem}_{near}_over_{far}"] = F.coalesce(F.col(c) / F.nullif(F.col(f"{stem}_{far}"), F.lit(0)), F.lit(0.0))
    return df.withColumns(out) if out else df


def apply_view(df: DataFrame, fn: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """fn(df), which may only add columns: the same keys, as often, and the old columns are required."""
    out = fn(df)
    if lost := [c for c in df.columns if c not in out.columns]:
        raise ValueError(f"a view may not drop columns: {lost}")
    a, b = (x.groupBy(key).agg(F.count("*").alias("n")) for x in (df, out))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("a view may not change the rows")
    return out


def feature_block(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], key: str, sources: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key and columns (float) that fn makes of the source columns, batch by batch; rows must not depend on each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = fn(batch[list(sources)])[list(columns)].astype("float32")
            if len(made) != len(batch):
                raise ValueError("a block returns a row for each row")
            yield pd.concat([batch[[key]].reset_index(drop=True), made.reset_index(drop=True)], axis=1)

    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{c} float" for c in columns)
    return df.select(key, *sources).mapInPandas(run, schema)


def candidate_transform(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], key: str, sources: Sequence[str], name: str = "candidate") -> DataFrame:
    """key and one numeric column of a user's function, computed twice; an error if the two runs differ."""
    block = lambda x: fn(x).to_frame(name)
    one, two = (feature_block(df, block, key, sources, [name]) for _ in range(2))
    sums = [x.agg(F.count("*"), F.sum(F.xxhash64(key, name).cast("decimal(38,0)"))).first() for x in (one, two)]
    if sums[0] != sums[1]:
        raise ValueError("the transform is not deterministic")
    return one


def tune_candidate(df: DataFrame, fn: Callable[[pd.DataFrame, dict], pd.Series], bounds: dict[str, tuple[float, float]], default: dict[str, float], key: str, sources: Sequence[str], label: str, tries: int = 24, around: int = 4, seed: int = 7, least: float = 1e-3) -> tuple[dict[str, float], DataFrame]:
    """Constants of fn(columns, constants) that rank the label best, on training rows alone, and the table of what was tried.

    tries draws within the bounds, then around points a constant in a quarter of
    its range about the best so far. All settings of a round are one pass:
    fn gives a column for each, and one grouped AUC judges them. The default
    stays if the best is not better by least. Table: setting, auc (either way
    round), and the constants.
    """
    rng, train = np.random.default_rng(seed), df.filter("split = 'train'")
    judged: list[tuple[float, dict[str, float]]] = []

    def judge(settings: list[dict[str, float]]) -> None:
        names = [f"s{k}" for k in range(len(settings))]
        block = lambda x: pd.DataFrame({n: fn(x.drop(columns="__label"), s) for n, s in zip(names, settings, strict=True)} | {"__label": x["__label"]})
        labelled = train.withColumn("__label", F.col(label).cast("float"))
        long = melt(feature_block(labelled, block, key, [*sources, "__label"], [*names, "__label"]), names, ["__label"]).withColumnRenamed("__label", label)
        scored = {r.feature: r.auc for r in auc(long, label, "value", ["feature"]).collect()}  # a row for each setting
        judged.extend((max(a, 1 - a), s) for n, s in zip(names, settings, strict=True) if (a := scored.get(n)) is not None)

    judge([default, *({c: float(rng.uniform(*b)) for c, b in bounds.items()} for _ in range(tries))])
    best = max(judged, key=lambda x: x[0])[1] if judged else default
    near = lambda c: np.linspace(max(bounds[c][0], best[c] - (bounds[c][1] - bounds[c][0]) / 4), min(bounds[c][1], best[c] + (bounds[c][1] - bounds[c][0]) / 4), around)
    judge([best | {c: float(v)} for c in sorted(bounds) for v in near(c)])
    first = next((a for a, s in judged if s == default), None)
    top, best = max(judged, key=lambda x: x[0], default=(None, default))
    chosen = best if first is not None and top - first >= least else default
    schema = ", ".join(["setting int", "auc double", *(f"`{c}` double" for c in bounds)])
    return chosen, df.sparkSession.createDataFrame([(k, a, *(float(s[c]) for c in bounds)) for k, (a, s) in enumerate(judged)], schema)


def attach_features(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with side, which must have each key once."""
    if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{list(keys)} repeat")
    return df.join(side, list(keys), "left")


def history_to_sequence(child: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], between: str = ";", within: str = "|") -> DataFrame:
    """key, n, seq: a key's rows in order as f1|f2;f1|f2, nulls empty, separators in values escaped."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\;|])", r"\\$1")
    record = F.concat_ws(within, *[clean(f) for f in fields]).alias("__r")
    rows = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, record))).alias("a"))
    return rows.select(key, F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["__r"]), between).alias("seq"))


def window_counts(events: DataFrame, id_: str, t: str, reference: str, windows: Sequence[int] = (7, 14, 30, 60, 90, 180, 365)) -> DataFrame:
    """id and n_w for each window: events in the w days before the reference day, and n_a over n_b for neighbours."""
    ago = F.datediff(F.lit(reference).cast("date"), F.col(t))
    counts = events.filter(ago > 0).groupBy(id_).agg(*[F.count_if(ago <= w).alias(f"n_{w}") for w in windows])
    return counts.withColumns({f"r_{a}_{b}": F.col(f"n_{a}") / F.nullif(f"n_{b}", F.lit(0)) for a, b in zip(windows, windows[1:], strict=False)})


def frequency_encode(train: DataFrame, df: DataFrame, col: str) -> DataFrame:
    counts = train.groupBy(col).agg(F.count("*").alias(f"{col}_freq"))
    return df.join(counts, col, "left").withColumn(f"{col}_freq", F.coalesce(f"{col}_freq", F.lit(0)))


def target_encode_oof(df: DataFrame, col: str, label: str, key: str, k: int = 5, smooth: float = 20.0, seed: int = 7) -> DataFrame:
    """df with col_te: the label's mean of the level over the other folds, drawn to the overall mean."""
    rows = df.withColumn("__fold", F.pmod(md5_number(seed, key), F.lit(k)))
    cells = rows.groupBy(col, "__fold").agg(F.count(label).alias("n"), F.sum(label).alias("s"))
    level = cells.groupBy(col).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    prior = cells.agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("prior"))
    table = cells.join(level, col).crossJoin(F.broadcast(prior))  # one row
    made = (F.col("ts") - F.coalesce("s", F.lit(0)) + smooth * F.col("prior")) / (F.col("tn") - F.col("n") + smooth)
    return rows.join(table.select(col, "__fold", made.alias(f"{col}_te")), [col, "__fold"], "left").drop("__fold")


def missing_pattern(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df with is-null flags, their number and their pattern as a string of 0 and 1."""
    flags = [F.col(c).isNull().cast("int") for c in cols]
    return df.withColumns({f"{c}_null": f for c, f in zip(cols, flags, strict=True)} | {"n_null": sum(flags, F.lit(0)), "null_pattern": F.concat(*[f.cast("string") for f in flags])})


def prepare_benchmark_sample(df: DataFrame, target: str, positive: str | None = None, log_target: bool = False, date: str | None = None) -> DataFrame:
    """Safe column names, booleans as int, the positive class as label 1 or log1p of the target, the day as dt."""
    import re

    safe = {c: re.sub(r"[^0-9A-Za-z_]+", "_", c).strip("_") for c in df.columns}
    rows = df.select(*[(F.col(f"`{c}`").cast("int") if kind == "boolean" else F.col(f"`{c}`")).alias(safe[c]) for c, kind in df.dtypes])
    y = F.col(safe[target])
    label = (y == F.lit(positive)).cast("int") if positive is not None else F.log1p(y) if log_target else y
    out = rows.withColumn("label", label)
    return out.withColumn("dt", F.to_date(safe[date])) if date else out


def compound_math(df: DataFrame, c: str, mu: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """df with second-layer transforms of c: log1p and sqrt of the absolute value, cbrt, tanh, sin, x / (x + 1e-6), a Gaussian kernel, a piecewise ramp."""
    x = F.col(c)
    z = (x - mu) / sigma
    return df.withColumns({
        f"{c}_log1p": F.log1p(F.abs(x)), f"{c}_sqrt": F.sqrt(F.abs(x)), f"{c}_cbrt": F.cbrt(x), f"{c}_tanh": F.tanh(z), f"{c}_sin": F.sin(z), f"{c}_square": x * x,
        f"{c}_fraction": x / F.nullif(F.abs(x) + 1e-6, F.lit(0.0)), f"{c}_decay": F.exp(-F.abs(z)), f"{c}_kernel": F.exp(-z * z), f"{c}_ramp": F.when(z < -1, -1.0).when(z > 1, 1.0).otherwise(z),
    })


def erf_column(c: Column) -> Column:
    """The error function by a published rational approximation (largest error 1.5e-7)."""
    # Fixed values of that approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(c))
    poly = sum((k * F.pow(t, F.lit(i + 1)) for i, k in enumerate(a)), F.lit(0.0))
    return F.signum(c) * (1 - poly * F.exp(-c * c))


def interactions(df: DataFrame, a: str, b: str, k: float = 0.5, eps: float = 1e-6) -> DataFrame:
    x, y = F.col(a), F.col(b)
    safe = lambda n, m: n / F.nullif(m, F.lit(0.0))
    return df.withColumns({"difference": x - y, "weighted_sum": x + k * y, "ratio": safe(x, y + eps), "share": safe(x, x + y + eps), "product": x * y})


def percent_rank_feature(df: DataFrame, c: str, name: str = "percent_rank") -> DataFrame:
    """df with the average rank of c over the number of its values; null stays null."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__c"))
    ranked = prefix_sums(counts, [c], {"__u": F.col("__c")}, (), None)
    total = counts.agg(F.sum("__c").alias("__n"))
    table = ranked.crossJoin(F.broadcast(total)).select(c, ((F.col("__u") - (F.col("__c") - 1) / 2) / F.col("__n")).alias(name))  # one row
    return df.join(table, c, "left")


def quantile_bin_feature(train: DataFrame, df: DataFrame, score: str, n: int = 8, name: str = "score_bin") -> DataFrame:
    """df with the training quantile bin of score, from 1; null stays null."""
    edges = quantile_edges(train.select(F.lit(0).alias("one"), F.col(score).cast("double").alias("value")), n, ["one"]).select("edges")
    at = bin_index(F.col(score).cast("double"), inner(F.col("edges")), "left") + 1
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(score).isNotNull(), at)).drop("edges")  # one row


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """df with the share of its level among all rows and the code of the level in sorted order (from 0)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__c"))
    coded = prefix_sums(counts, [col], {}, (), f"{col}_code")
    n = df.agg(F.count("*").alias("__n"))
    table = coded.crossJoin(F.broadcast(n)).select(col, (F.col("__c") / F.col("__n")).alias(f"{col}_share"), f"{col}_code")  # one row
    return df.join(table, col, "left")


def recency_decay(events: DataFrame, id_: str, t: str, value: str, reference: str, half_life: float, last: int = 3) -> DataFrame:
    """id, days since the last event and since the k-th last ones, decayed count and sum."""
    ago = F.datediff(F.lit(reference).cast("date"), F.to_date(t))
    w = F.exp(-math.log(2) * ago / half_life)
    rows = events.filter(ago > 0).withColumn("__ago", ago)
    nth = F.sort_array(F.collect_list("__ago"))  # cut to the last ones below; an entity's history
    return rows.groupBy(id_).agg(F.sum(w).alias("decayed_count"), F.sum(w * F.col(value)).alias("decayed_sum"), F.slice(nth, 1, last).alias("__a")).select(id_, "decayed_count", "decayed_sum", *[F.get("__a", F.lit(k)).alias(f"days_since_{k + 1}") for k in range(last)])


def period_buckets(events: DataFrame, id_: str, t: str, value: str, unit: str, periods: Sequence[str]) -> DataFrame:
    """id and, for each period, the number of events and the sum of values."""
    rows = events.withColumn("__p", F.date_format(F.date_trunc(unit, t), "yyyy-MM-dd")).filter(F.col("__p").isin(*periods))
    return rows.groupBy(id_).pivot("__p", list(periods)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"))


def event_aggregates(events: DataFrame, id_: str, t: str, value: str, kind: str, funnel: Sequence[str] = ()) -> DataFrame:
    """id, count, sum, mean, extremes, variance, slope a day, and the share of the funnel's steps reached in order."""
    day = F.unix_timestamp(t) / 86400.0
    v = F.col(value)
    spread = F.var_pop(day)
    out = [F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.var_samp(v).alias("variance"), (F.covar_pop(v, day) / F.when(spread > 1e-9, spread)).alias("slope")]
    out += [F.min(F.when(F.col(kind) == s, F.col(t))).alias(f"__s{i}") for i, s in enumerate(funnel)]
    table = events.groupBy(id_).agg(*out)
    reached, ok = F.lit(0), F.lit(True)
    for i in range(len(funnel)):
        ok = ok & F.col(f"__s{i}").isNotNull() & (F.col(f"__s{i}") >= F.col(f"__s{i - 1}") if i else F.lit(True))
        reached = reached + F.coalesce(ok, F.lit(False)).cast("int")
    share = (reached / len(funnel)).alias("funnel") if funnel else F.lit(None).cast("double").alias("funnel")
    return table.select(id_, "n", "total", "mean", "least", "most", "variance", "slope", share)


def sequence_structure(events: DataFrame, id_: str, t: str, tie: str, kind: str) -> DataFrame:
    """id, n, bigrams (distinct), repeats (same kind twice running), entropy of kinds (bits), median gap in seconds."""
    w = Window.partitionBy(id_).orderBy(t, tie)  # an entity's history
    micros = F.unix_micros(F.col(t).cast("timestamp"))
    rows = events.select(id_, kind, t, F.lag(kind).over(w).alias("__before"), (micros - F.lag(micros).over(w)).alias("__gap"))
    base = rows.groupBy(id_).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("__before").isNotNull(), F.concat_ws(">", "__before", kind))).alias("bigrams"), F.count_if(F.col("__before") == F.col(kind)).alias("repeats"), (F.percentile("__gap", F.lit(0.5)) / 1e6).alias("median_gap"))
    kinds = events.groupBy(id_, kind).agg(F.count("*").alias("c"))
    total = kinds.groupBy(id_).agg(F.sum("c").alias("__n"))
    p = F.col("c") / F.col("__n")
    return base.join(kinds.join(total, id_).groupBy(id_).agg((-F.sum(p * F.log2(p))).alias("entropy")), id_)


def group_statistics(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """df with the group's mean and deviation of each column, and the ratio and difference to the mean."""
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("group_mean", F.avg), ("group_std", F.stddev_pop))])
    rows = df.join(stats, list(keys))
    return rows.withColumns({f"{c}_vs_group": F.col(c) - F.col(f"{c}_group_mean") for c in cols} | {f"{c}_over_group": F.col(c) / F.when(F.abs(f"{c}_group_mean") > 1e-12, F.col(f"{c}_group_mean")) for c in cols})
