"""Statistical comparison: bootstrap by hashed Poisson weights, leaderboards, multiple tests, noise."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.primitives import prefix_sums, written

from .evaluation import with_segments
from .ranking import auc

#: The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


#: Weights are draws by two quadratic steps modulo a prime, which SQL, Spark and numpy compute alike.
PRIME = 2**31 - 1
#: Weights that a task holds at a time.
CELLS = 2_000_000
#: Numbers that are drawn at a time, few enough for a core's cache.
CACHED = 16_384


def key_number(df: DataFrame, key: str) -> Column:
    """A number below PRIME for each key: whole numbers by remainder, others by their CRC."""
    whole = df.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return F.pmod(F.col(key).cast("long") if whole else F.crc32(F.col(key).cast("string")), F.lit(PRIME))


#: Where a number below PRIME falls among the borders of the weights; of its first 16 bits, -1 where a border is among such numbers.
BORDERS = np.array([int(p * PRIME) for p in POISSON])
_FIRST = np.searchsorted(BORDERS, np.arange(1 << 16) << 15, "right").astype(np.int8)
_FIRST[BORDERS >> 15] = -1


def _folded(x: np.ndarray, high: np.ndarray) -> None:
    """x modulo PRIME or up to 3 more than that, in place, for numbers below 2 ** 63: bits from the 31st on count like those from the first on."""
    for _ in range(2):
        np.right_shift(x, 31, out=high)
        x &= PRIME
        x += high


def _weights(keys: np.ndarray, n_boot: int, seed: int, first: int = 0) -> np.ndarray:
    r = np.arange(first, first + n_boot, dtype=np.int64)
    out = np.empty((len(keys), n_boot), np.int8)
    own, each, last = keys.astype(np.int64) * 69621 % PRIME, (r * 16807 + (seed * 48271 + 1)) % PRIME, r * 7919 + 7
    step = max(1, CACHED // max(n_boot, 1))
    held = np.empty((3, step, n_boot), np.int64)
    for at in range(0, len(keys), step):
        x, y, high = held[:, : len(out[at : at + step])]
        np.add(own[at : at + step, None], each, out=x)
        np.add(x, 40692, out=y)
        y *= x
        y += 12345
        _folded(y, high)
        np.add(y, 48271, out=x)
        x *= y
        x += last
        _folded(x, high)
        np.subtract(x, PRIME, out=x, where=x >= PRIME)
        np.right_shift(x, 15, out=high)
        part = np.take(_FIRST, high)
        near = np.nonzero(part < 0)
        part[near] = np.searchsorted(BORDERS, x[near], "right")
        out[at : at + step] = part
    return out


def draws(keys: np.ndarray, n_boot: int, seed: int, first: int = 0) -> np.ndarray:
    """Poisson(1) weights, a row for each key and a column for each replicate from the first on, fixed by key, replicate and seed."""
    return _weights(keys, n_boot, seed, first).astype(np.int64)


class _Curve:
    """Sums of one score in one part of its order: the first and the last value by themselves, as other parts may have them too, and all between."""

    def __init__(self, name: str):
        self.name, self.out, self.value, self.first = name, [], None, None
        self.inside = None

    def add(self, values: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Distinct rising values with their weighted counts (a row each); the first may go on from the last call."""
        if self.value is not None and values[0] == self.value:
            pos[0] += self.pos
            neg[0] += self.neg
        elif self.value is not None:
            values, pos, neg = np.append(self.value, values), np.vstack([self.pos, pos]), np.vstack([self.neg, neg])
        self.value, self.pos, self.neg = values[-1], pos[-1].copy(), neg[-1].copy()
        values, pos, neg = values[:-1], pos[:-1], neg[:-1]
        if self.first is None and len(values):
            self.first = values[0]
            self.out.append((self.first, 0, pos[0], neg[0], np.zeros(len(pos[0]))))
            pos, neg = pos[1:], neg[1:]
        if len(pos):
            p, n, area = self.inside or (0, 0, 0.0)
            before = np.cumsum(neg, 0) - neg + n
            self.inside = p + pos.sum(0), n + neg.sum(0), area + (pos * (before + neg / 2)).sum(0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.value is not None:
            self.out.append((self.value, 0, self.pos, self.neg, np.zeros(len(self.pos))))
        if self.inside is not None:
            self.out.append((self.first, 1, *self.inside))
        for value, kind, pos, neg, area in self.out:
            n = len(pos)
            arrays = [pa.array([self.name] * n), pa.array(np.full(n, value)), pa.array(np.full(n, kind, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(pos.astype(np.int64)), pa.array(neg.astype(np.int64)), pa.array(area)]
            yield pa.RecordBatch.from_arrays(arrays, ["score", "value", "kind", "replicate", "pos", "neg", "area"])


def _added(w: np.ndarray) -> np.ndarray:
    """Sums of the columns; 4,000 weights of at most 8 fit into 16 bits."""
    return sum((w[k : k + 4_000].sum(0, dtype=np.int16).astype(np.int64) for k in range(0, len(w), 4_000)), np.zeros(w.shape[1], np.int64))


def _partial_curves(n_boot: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, step = None, max(1, CELLS // n_boot)
        for batch in batches:
            names = np.array(batch.column("score").to_pylist())
            values, label, keys = (batch.column(c).to_numpy() for c in ("value", "label", "key"))
            edges = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() if len(names) else []
            for a, b in zip(edges, [*edges[1:], len(names)], strict=True):
                if curve is None or curve.name != str(names[a]):
                    if curve:
                        yield from curve.rows()
                    curve = _Curve(str(names[a]))
                for at in range(a, b, step):
                    part = slice(at, min(at + step, b))
                    new = np.append(True, np.diff(values[part]) > 0)
                    cell, n = 2 * np.cumsum(new) - 2 + (label[part] != 1), int(new.sum())  # of a value and a class
                    order = np.argsort(cell, kind="stable")
                    w, ordered = _weights(keys[part][order], n_boot, seed), cell[order]
                    starts = np.flatnonzero(np.append(True, np.diff(ordered) > 0))
                    sums = np.zeros((2 * n, n_boot), np.int64)
                    for i, j in zip(starts, [*starts[1:], len(ordered)], strict=True):
                        sums[ordered[i]] = w[i] if j == i + 1 else _added(w[i:j])
                    curve.add(values[part][np.flatnonzero(new)], sums[::2].copy(), sums[1::2].copy())
        if curve:
            yield from curve.rows()

    return run


def bootstrap_auc(df: DataFrame, label: str, scores: Sequence[str], key: str, n_boot: int, seed: int) -> DataFrame:
    """score, replicate, auc of each score in each replicate, null for one class; rows without a label or score don't count for it.

    A row's Poisson(1) weights depend on its key alone. Rows are brought in the
    order of each score once; every task draws all replicates of its rows and
    gives three rows of sums for each. A value that many rows share spans
    several tasks.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in scores]))
    rows = df.filter(F.col(label).isNotNull()).select((F.col(label) == 1).cast("int").alias("label"), key_number(df, key).alias("key"), pairs.alias("_")).select("_.*", "label", "key")
    dealt = rows.filter("value IS NOT NULL AND NOT isnan(value)").repartitionByRange("score", "value", "key").sortWithinPartitions("score", "value")
    parts = dealt.mapInArrow(_partial_curves(n_boot, seed), "score string, value double, kind int, replicate int, pos long, neg long, area double")
    sums = parts.groupBy("score", "replicate", "value", "kind").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "area")])
    line = Window.partitionBy("score", "replicate").orderBy("value", "kind")  # three rows for each task
    before = F.sum("neg").over(line) - F.col("neg")
    area = F.col("area") + F.col("pos") * (F.col("before") + F.when(F.col("kind") == 0, F.col("neg") / 2).otherwise(0))
    whole = sums.withColumn("before", before).groupBy("score", "replicate")
    return whole.agg((F.sum(area) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    q = F.percentile(column, F.array(F.lit(a), F.lit(1 - a)))
    return values.agg(F.count(column).alias("replicates"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("se"), q.alias("q"), F.avg((F.col(column) > 0).cast("double")).alias("share_positive")).select("replicates", "mean", "se", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_positive")


def bootstrap_ci(df: DataFrame, label: str, score: str, key: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """One row: replicates, mean, se, low, high of the AUC."""
    return interval(bootstrap_auc(df, label, [score], key, n_boot, seed), "auc").drop("share_positive")


def paired_bootstrap(df: DataFrame, label: str, new: str, old: str, key: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """One row: the change of AUC from old to new under the same weights, its error, interval, share above zero, z."""
    each = bootstrap_auc(df.filter(F.col(new).isNotNull() & F.col(old).isNotNull()), label, [new, old], key, n_boot, seed)
    side = lambda name: F.max(F.when(F.col("score") == name, F.col("auc")))
    out = interval(each.groupBy("replicate").agg((side(new) - side(old)).alias("delta")), "delta")
    return out.withColumn("z", F.col("mean") / F.nullif("se", F.lit(0.0)))


def weighted_auc(df: DataFrame, label: str, score: str, weight: str) -> DataFrame:
    return auc(df, label, score, weight=F.col(weight))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.10, family: Sequence[str] = ()) -> DataFrame:
    """df with passed: p up to the largest one with p <= r q / k passes; null p never does.

    Tests are ranked by their distinct p over many tasks, so a family may be
    large; of equal p all have the highest rank among them, as the largest
    rank decides.
    """
    named = {g: f"__g{i}" for i, g in enumerate(family)}
    counts = df.filter(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("__value")).agg(F.count("*").alias("__n"))
    ranked = prefix_sums(counts, ["__value"], {"__r": F.col("__n")}, family, None)
    sizes = ranked.groupBy(*family).agg(F.max("__r").alias("__k")).withColumnsRenamed(named)  # a row for each family
    match = lambda right: functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(right[c]) for g, c in named.items()], F.lit(True))
    hit = ranked.join(sizes, match(sizes)).filter(F.col("__value") <= F.col("__r") * q / F.col("__k"))
    cut = hit.groupBy(*family).agg(F.max("__value").alias("__cut")).withColumnsRenamed(named)
    return df.join(cut, match(cut), "left").withColumn("passed", F.coalesce(F.col(p) <= F.col("__cut"), F.lit(False))).drop("__cut", *named.values())


#: How much below a limit still counts as at it: sums come out differently by as little, by the order in which rows are added.
TIE = 1e-9


def noise_gate(df: DataFrame, delta: str, se: str, higher_is_better: bool = True, smallest: float = 0.0) -> DataFrame:
    """df with gain and verdict: better or worse from one error (and the smallest effect) on, likely from half on, else noise; at a limit is reached, whatever the last bits."""
    gain = F.col(delta) * (1 if higher_is_better else -1)
    z = gain / F.nullif(se, F.lit(0.0))
    verdict = F.when((z >= 1 - TIE) & (gain >= smallest - TIE), "better").when(z >= 0.5 - TIE, "likely_better").when(z <= TIE - 1, "worse").when(z <= TIE - 0.5, "likely_worse").otherwise("noise")
    return df.withColumn("gain", gain).withColumn("verdict", verdict)


def aligned_leaderboard(df: DataFrame, label: str, participants: Sequence[str], key: str, reference: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """participant, auc, rank (ties share), delta to the reference with its interval, verdict, over the rows that all have scores for."""
    rows = df.dropna(subset=list(participants))
    pairs = F.array(*[F.struct(F.lit(p).alias("participant"), F.col(p).alias("s")) for p in participants])
    long = lambda d, *keep: d.select(label, *keep, F.explode(pairs).alias("x")).select(label, *keep, "x.*")
    board = auc(long(rows), label, "s", ["participant"])
    each = written(bootstrap_auc(rows, label, participants, key, n_boot, seed), "replicates").withColumnRenamed("score", "participant")
    base = each.filter(F.col("participant") == reference).select("replicate", F.col("auc").alias("base"))
    deltas = each.join(base, "replicate").groupBy("participant").agg(F.avg(F.col("auc") - F.col("base")).alias("delta"), F.percentile(F.col("auc") - F.col("base"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = board.join(deltas, "participant").withColumn("rank", F.rank().over(Window.orderBy(F.desc("auc"))).cast("long"))
    low, high = F.col("q")[0], F.col("q")[1]
    verdict = F.when(F.col("participant") == reference, "reference").when(low > 0, "better").when(high < 0, "worse").otherwise("tie")
    return out.select("participant", "auc", "rank", "delta", low.alias("low"), high.alias("high"), verdict.alias("verdict"))


def slice_gate(df: DataFrame, label: str, new: str, old: str, slices: Sequence[str], least: int = 50) -> DataFrame:
    """segment, rows, new_auc, old_auc, delta of each slice of at least least rows, worst (the smallest delta)."""
    rows = with_segments(df, slices)
    n = rows.groupBy("segment").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)
    a, b = auc(rows, label, new, ["segment"]).withColumnRenamed("auc", "new_auc"), auc(rows, label, old, ["segment"]).withColumnRenamed("auc", "old_auc")
    out = n.join(a, "segment").join(b, "segment").withColumn("delta", F.col("new_auc") - F.col("old_auc"))
    return out.withColumn("worst", F.col("delta") == F.min("delta").over(Window.partitionBy()))


def slice_and_period_gate(df: DataFrame, label: str, new: str, old: str, slices: Sequence[str], period: str, key: str, least: int = 50, alpha: float = 0.05, by_size: bool = False, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """kind (slice or period), segment, rows, new_auc, old_auc, delta, se, reach, worst, passed.

    se is the bootstrap error of the change over all rows. The worst of k
    slices may fall by less than z(1 - alpha / k) errors (by_size: times the
    root of k, as a slice has a k-th of the rows), the worst period by 2 at
    most; without an error no fall is allowed. passed is of the kind. Segments
    under least rows or of one class don't take part; they are few.
    """
    noise = paired_bootstrap(df, label, new, old, key, n_boot, seed).first()["se"]
    parts = [slice_gate(df, label, new, old, slices, least).select(F.lit("slice").alias("kind"), "*"), slice_gate(df, label, new, old, [period], least).select(F.lit("period").alias("kind"), "*")]
    rows = written(parts[0].unionByName(parts[1]).filter("delta IS NOT NULL AND segment <> 'all'").drop("worst"), "segments")
    k = max(1, rows.filter("kind = 'slice'").count())
    every = Window.partitionBy("kind")  # a row for each segment
    times = F.when(F.col("kind") == "period", 2.0).otherwise(NormalDist().inv_cdf(1 - alpha / k) * (k**0.5 if by_size else 1.0))
    out = rows.withColumn("se", F.lit(noise).cast("double")).withColumn("reach", F.coalesce(times * F.col("se"), F.lit(0.0)))
    low = F.min("delta").over(every)
    passed = F.when(F.col("kind") == "period", low >= -F.col("reach")).otherwise(F.when(F.col("se") > 0, low > -F.col("reach")).otherwise(low >= 0))
    return out.withColumn("worst", F.col("delta") == low).withColumn("passed", passed)


def lift_capture(base: Column, achieved: Column, reference: Column, higher_is_better: bool = True) -> Column:
    """The share of the gap from base to reference that was closed; null if there is no gap."""
    sign = 1 if higher_is_better else -1
    gap = (reference - base) * sign
    return F.when(gap > 0, (achieved - base) * sign / F.nullif(gap, F.lit(0.0)))
