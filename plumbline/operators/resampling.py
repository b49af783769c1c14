"""Bootstrap replicates of metrics that depend on the order of the scores, and of means of losses.

Rows are brought in order once and dealt into parts. In a first pass each part
gives its weighted sums of every replicate, and those of its first and last
score, which other parts may have too; sums over the parts before it and of equal
scores around it come back to each part, and a second pass gives its share of
each metric. A part draws its rows' weights itself, some replicates at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.primitives import discard, written

from .comparison import CELLS, draws, interval, key_number

#: Metrics of a label and a score by its order; of a value and its prediction by losses.
ORDERED = ("auc", "ks", "pr_auc")
LOSSES = {
    "logloss": lambda y, s: -F.when(y == 1, F.ln(s)).when(y.isNotNull(), F.ln(1 - s)),
    "brier": lambda y, s: (s - y) * (s - y),
    "mse": lambda y, s: (s - y) * (s - y),
    "rmse": lambda y, s: (s - y) * (s - y),
    "mae": lambda y, s: F.abs(s - y),
}
_EDGES = ("t", "f", "l")


def _blocks(keys: np.ndarray, n_boot: int, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Weights of all rows, some replicates at a time."""
    step = max(1, CELLS // max(len(keys), 1))
    for at in range(0, n_boot, step):
        some = slice(at, min(at + step, n_boot))
        yield some, draws(keys, some.stop - at, seed, at).astype(np.float64)


def _columns(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores falling, keys, and the n columns that are added up, in order."""
    value, key = table["value"].to_numpy(), table["key"].to_numpy()
    order = np.lexsort((key, -value))
    return value[order], key[order], np.stack([table[f"x{k}"].to_numpy()[order] for k in range(n)])


def _first_pass(n: int, n_boot: int, seed: int):
    def run(part: tuple, table: pa.Table) -> pa.Table:
        value, key, x = _columns(table, n)
        sums = np.zeros((3, n, n_boot))
        first, last = value == value[0], value == value[-1]
        for some, w in _blocks(key, n_boot, seed):
            for e, rows in enumerate((slice(None), first, last)):
                sums[e, :, some] = x[:, rows] @ w[rows]
        made = {"part": [part[0].as_py()], "first": [float(value[0])], "last": [float(value[-1])]}
        return pa.table(made | {f"{e}{k}": [sums[i, k].tolist()] for i, e in enumerate(_EDGES) for k in range(n)}).cast(_schema(n))

    return run


def _schema(n: int) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), *[(f"{e}{k}", pa.list_(pa.float64())) for e in _EDGES for k in range(n)]])


def _offsets(sums: DataFrame, n: int) -> DataFrame:
    """part, o: for each replicate in order, the sums before the part, over all, of equal scores before its first and after its last."""
    zipped = F.posexplode(F.arrays_zip(*[f"{e}{k}" for e in _EDGES for k in range(n)])).alias("replicate", "s")
    each = sums.select("part", "first", "last", zipped).select("part", "first", "last", "replicate", "s.*")
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("replicate")  # a row for each part
    base = each.select("part", "replicate", *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0.0)).alias(f"b{k}") for k in range(n)], *[F.sum(f"t{k}").over(whole).alias(f"n{k}") for k in range(n)])
    ends = each.select("part", "replicate", F.explode(F.array(*[F.struct(F.lit(e == "l").alias("end"), F.col(c).alias("value"), *[F.col(f"{e}{k}").alias(f"v{k}") for k in range(n)]) for e, c in (("f", "first"), ("l", "last"))])).alias("e")).select("part", "replicate", "e.*")
    same = Window.partitionBy("replicate", "value").orderBy("part")
    earlier = same.rangeBetween(Window.unboundedPreceding, -1)
    later = same.rangeBetween(1, Window.unboundedFollowing)
    around = lambda k: F.when(F.col("end"), F.sum(F.when(~F.col("end"), F.col(f"v{k}")).otherwise(0.0)).over(later)).otherwise(F.sum(F.when(F.col("end"), F.col(f"v{k}")).otherwise(0.0)).over(earlier))
    tied = ends.select("part", "replicate", "end", *[F.coalesce(around(k), F.lit(0.0)).alias(f"a{k}") for k in range(n)])
    sides = tied.groupBy("part", "replicate").agg(*[F.sum(F.when(F.col("end") == side, F.col(f"a{k}")).otherwise(0.0)).alias(f"{name}{k}") for name, side in (("p", False), ("q", True)) for k in range(n)])
    rows = base.join(sides, ["part", "replicate"])
    numbers = F.array(*[f"{e}{k}" for e in ("b", "n", "p", "q") for k in range(n)])
    return rows.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", numbers.alias("o")))), lambda x: x["o"]).alias("o"))  # an element for each replicate


def _replicates(rows: DataFrame, n: int, n_boot: int, seed: int, names: Sequence[str], share, most: Sequence[str] = ()) -> DataFrame:
    """replicate and the names, that share(value, x, w, offsets) gives for each part: sums over the parts, of `most` the largest.

    rows: value, key, x0 ... (numbers that are weighted and added up). Offsets:
    arrays (before, all, tied before the first score, tied after the last one) by
    (number, replicate).
    """
    dealt = rows.repartitionByRange(F.col("value").desc(), "key").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "scores")
    sums = written(dealt.groupBy("part").applyInArrow(_first_pass(n, n_boot, seed), "part int, first double, last double, " + ", ".join(f"{e}{k} array<double>" for e in _EDGES for k in range(n))), "part-sums")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        value, key, x = _columns(left, n)
        offsets = np.array(right["o"][0].as_py()).reshape(n_boot, 4, n).transpose(1, 2, 0)
        out = np.concatenate([share(value, x, w, offsets[:, :, some]) for some, w in _blocks(key, n_boot, seed)], 1)
        return pa.table([pa.array(range(n_boot), pa.int32()), *[pa.array(o) for o in out]], ["replicate", *names])

    parts = dealt.groupBy("part").cogroup(_offsets(sums, n).groupBy("part")).applyInArrow(second, "replicate int, " + ", ".join(f"{c} double" for c in names))
    out = written(parts.groupBy("replicate").agg(*[(F.max if c in most else F.sum)(c).alias(c) for c in names]), "replicates")
    discard(dealt, sums)
    return out


def bootstrap_ordered(df: DataFrame, label: str, score: str, key: str, n_boot: int, seed: int = 7) -> DataFrame:
    """replicate, auc, ks, pr_auc under Poisson weights that depend on the row key alone; null for one class.

    Equal scores count together, wherever they are. Rows without a label or a
    score are left out. A score that many rows share spans several parts.
    """
    s = F.col(score).cast("double")
    one = (F.col(label) == 1).cast("double")
    rows = df.filter(F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s)).select(s.alias("value"), key_number(df, key).alias("key"), one.alias("x0"), (1 - one).alias("x1"))

    def share(value, x, w, offsets):
        before, total, earlier, later = offsets
        new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        pos, neg = (np.add.reduceat(w * column[:, None], new) for column in x)
        upto = [np.cumsum(own, 0) + b for own, b in zip((pos, neg), before, strict=True)]
        for u, after in zip(upto, later, strict=True):
            u[-1] += after
        tied = neg.copy()
        tied[0] += earlier[1]
        tied[-1] += later[1]
        auc = (pos * (total[1] - upto[1] + tied / 2)).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.abs(upto[0] / total[0] - upto[1] / total[1]).max(0)
            precision = (pos * np.nan_to_num(upto[0] / (upto[0] + upto[1]))).sum(0)
            return np.stack([auc / (total[0] * total[1]), gap, precision / total[0]])

    out = _replicates(rows, 2, n_boot, seed, ORDERED, share, ["ks"])
    return out.select("replicate", *[F.when(~F.isnan("auc") & ~F.isnan("ks"), F.col(c)).alias(c) for c in ORDERED])


def bootstrap_means(df: DataFrame, key: str, losses: Mapping[str, Column], n_boot: int, seed: int = 7) -> DataFrame:
    """replicate and the weighted mean of each column under Poisson weights; rows where one is null are left out. Nothing is ordered."""
    named = list(losses)
    rows = df.select(key_number(df, key).alias("key"), *[losses[c].cast("double").alias(f"x{k}") for k, c in enumerate(named)]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(named) + 1, n_boot))
        for batch in batches:
            x = np.stack([np.ones(len(batch)), *[batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(len(named))]])
            for some, w in _blocks(batch.column("key").to_numpy(zero_copy_only=False), n_boot, seed):
                sums[:, some] += x @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(n_boot), pa.int32()), *[pa.array(s) for s in sums]], ["replicate", "w", *[f"x{k}" for k in range(len(named))]])

    parts = rows.mapInArrow(run, "replicate int, w double, " + ", ".join(f"x{k} double" for k in range(len(named))))
    return parts.groupBy("replicate").agg(*[(F.sum(f"x{k}") / F.nullif(F.sum("w"), F.lit(0.0))).alias(c) for k, c in enumerate(named)])


def bootstrap_uplift(df: DataFrame, score: str, arm: str, outcome: str, key: str, n_boot: int, seed: int = 7) -> DataFrame:
    """replicate, auuc, qini under Poisson weights: the area below the gain from the highest score on (ties by key), less the straight line; null without both arms.

    The gain after a row is the outcome of the treated less that of the
    control scaled to the treated; a row is a step as wide as its weight.
    """
    s, t, y = F.col(score).cast("double"), F.col(arm), F.col(outcome).cast("double")
    treated, control = (t == 1).cast("double"), (t == 0).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & t.isNotNull() & y.isNotNull()).select(s.alias("value"), key_number(df, key).alias("key"), (treated * y).alias("x0"), (control * y).alias("x1"), treated.alias("x2"), control.alias("x3"))

    def gain(yt, yc, nt, nc):
        with np.errstate(divide="ignore", invalid="ignore"):
            return yt - np.where(nc > 0, yc * nt / nc, 0.0)

    def share(value, x, w, offsets):
        before, total = offsets[0], offsets[1]
        sums = [np.vstack([b, b + np.cumsum(w * column[:, None], 0)]) for column, b in zip(x, before, strict=True)]
        g = gain(*sums)
        area = (w * (g[1:] + g[:-1]) / 2).sum(0)
        n, both = total[2] + total[3], (total[2] > 0) & (total[3] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            area = area / n
        last = gain(*total)
        return np.stack([np.where(both, area, np.nan), np.where(both, last, np.nan)])

    out = _replicates(rows, 4, n_boot, seed, ("auuc", "last"), share, ["last"])
    there = ~F.isnan("auuc")
    return out.select("replicate", F.when(there, F.col("auuc")).alias("auuc"), F.when(there, F.col("auuc") - F.col("last") / 2).alias("qini"))


def bootstrap_metric(df: DataFrame, metric: str, label: str, score: str, key: str, n_boot: int, seed: int = 7) -> DataFrame:
    """replicate, value of one metric: auc, ks, pr_auc, logloss (probabilities are clipped at 1e-15), brier, mse, rmse or mae."""
    if metric in ORDERED:
        return bootstrap_ordered(df, label, score, key, n_boot, seed).select("replicate", F.col(metric).alias("value"))
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    if metric == "logloss":
        s = F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15)))  # greatest skips nulls
    mean = bootstrap_means(df, key, {"value": LOSSES[metric](y, s)}, n_boot, seed)
    return mean.select("replicate", (F.sqrt("value") if metric == "rmse" else F.col("value")).alias("value"))


def metric_interval(df: DataFrame, metric: str, label: str, score: str, key: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """One row: replicates, mean, se, low, high of a metric."""
    return interval(bootstrap_metric(df, metric, label, score, key, n_boot, seed), "value").drop("share_positive")


def metric_change(df: DataFrame, metric: str, label: str, new: str, old: str, key: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """One row: the change of a metric from old to new under the same weights, over rows that have both: its error, interval, share above zero, z."""
    both = df.filter(F.col(new).isNotNull() & F.col(old).isNotNull())
    a, b = (bootstrap_metric(both, metric, label, s, key, n_boot, seed).withColumnRenamed("value", name) for s, name in ((new, "a"), (old, "b")))
    out = interval(a.join(b, "replicate").select((F.col("a") - F.col("b")).alias("delta")), "delta")
    return out.withColumn("z", F.col("mean") / F.nullif("se", F.lit(0.0)))
