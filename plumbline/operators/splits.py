"""Splits and samples that depend on content only: time, groups, and the md5 order of row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.primitives import global_rank, md5_number, md5_order, prefix_sums
from plumbline.functions.skew import smallest_by_hash


def _parts(share: Column, names: Sequence[str], ratios: Sequence[float], scale: Column | float = 1.0, cut=lambda c: c) -> Column:
    """The first name whose cumulative ratio (times scale, cut to a border) is above share."""
    out, total = F.lit(names[-1]), sum(ratios)
    for k in range(len(names) - 2, -1, -1):
        border = cut(F.lit(round(sum(ratios[: k + 1]) / total, 12)) * scale)
        out = F.when(share < border, names[k]).otherwise(out)
    return out


def split_by_ranges(df: DataFrame, dt: str, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of the closed date ranges (name, first, last), which rise and don't overlap; other rows go."""
    for (_, a, b), (_, c, _) in zip(ranges, [*ranges[1:], ("", "9999", "")], strict=True):
        if not a <= b < c:
            raise ValueError(f"ranges must rise: {ranges}")
    split = F.lit(None).cast("string")
    for name, first, last in ranges:
        split = F.when(F.col(dt).between(first, last), name).otherwise(split)
    return df.withColumn("split", split).filter("split IS NOT NULL")


def range_counts(df: DataFrame, dt: str, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """split, rows; split `dropped` is outside all ranges."""
    inside = split_by_ranges(df, dt, ranges).groupBy("split").agg(F.count("*").alias("rows"))
    outside = F.lit(True)
    for _, first, last in ranges:
        outside = outside & ~F.coalesce(F.col(dt).between(first, last), F.lit(False))
    return inside.unionByName(df.filter(outside).select(F.lit("dropped").alias("split")).groupBy("split").agg(F.count("*").alias("rows")))


def _by_time(df: DataFrame, t: str) -> DataFrame:
    """t, n, before, total: rows of each time value and before it. A row for each value, in order over many tasks."""
    counts = df.groupBy(t).agg(F.count("*").alias("n"))
    ordered = prefix_sums(counts, [t], {"__upto": F.col("n")}, rank=None)
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return ordered.crossJoin(total).select(t, "n", (F.col("__upto") - F.col("n")).alias("before"), "total")


def split_by_day_ratio(df: DataFrame, dt: str, ratios: Sequence[float], names: Sequence[str] = ("train", "test", "oot")) -> DataFrame:
    """Whole days, by the share of rows before each day."""
    days = _by_time(df, dt).select(dt, _parts(F.col("before") / F.col("total"), names, ratios).alias("split"))
    return df.drop("split").join(days, dt)


def split_by_row_ratio(df: DataFrame, dt: str, ratios: Sequence[float], key: str, names: Sequence[str] = ("train", "test", "oot")) -> DataFrame:
    """Rows in order of (time, key), cut at round-half-even of n times the cumulative ratio; an empty part is an error."""
    n = df.count()
    parts = _parts(F.col("rank"), names, ratios, F.lit(n), lambda c: F.bround(c))
    cuts = [0, *[round(n * sum(ratios[: k + 1]) / sum(ratios)) for k in range(len(ratios) - 1)], n]
    if any(a >= b for a, b in zip(cuts, cuts[1:], strict=False)):
        raise ValueError(f"an empty part: {cuts}")
    ranked = global_rank(df.drop("split"), [dt, key])
    return ranked.withColumn("split", parts).drop("rank")


def split_by_distinct_time(df: DataFrame, t: str, oot_ratio: float, val_ratio: float) -> DataFrame:
    """Cuts the list of distinct times: the last part is oot, the tail of the rest is val; each keeps one time at least."""
    times = global_rank(df.select(t).distinct(), [t], name="i")
    n = times.count()
    cut = max(1, min(n - 1, int(n * (1 - oot_ratio))))
    val = max(1, min(cut - 1, int(cut * (1 - val_ratio))))
    split = F.when(F.col("i") < val, "train").when(F.col("i") < cut, "val").otherwise("oot")
    return df.drop("split").join(times.select(t, split.alias("split")), t)


def split_random(df: DataFrame, ratios: dict[str, float], key: str, seed: int) -> DataFrame:
    """Parts in md5 order of the key; every part but the first has floor(n * ratio) rows."""
    n, names = df.count(), list(ratios)
    sizes = {k: int(n * ratios[k]) for k in names[1:]}
    borders, start = [], n - sum(sizes.values())
    split = F.lit(names[-1])
    for k in names[:-1]:
        borders.append((k, start))
        start += sizes[names[names.index(k) + 1]]
    for k, border in reversed(borders):
        split = F.when(F.col("rank") < border, k).otherwise(split)
    ranked = global_rank(df.drop("split").withColumn("__h", md5_order(seed, key)), ["__h", key])
    return ranked.withColumn("split", split).drop("rank", "__h")


def split_by_group(df: DataFrame, group: str, ratios: Sequence[float], seed: int, names: Sequence[str] = ("train", "test", "oot")) -> DataFrame:
    """Whole groups, in md5 order, cut at int(groups * cumulative ratio)."""
    groups = df.select(group).distinct()
    n = groups.count()
    ranked = global_rank(groups.withColumn("__h", md5_order(seed, group)), ["__h", group])
    parts = ranked.select(group, _parts(F.col("rank"), names, ratios, F.lit(n), F.floor).alias("split"))
    return df.drop("split").join(parts, group)


def split_stratified(df: DataFrame, strata: str, ratios: Sequence[float], key: str, seed: int, names: Sequence[str] = ("train", "test", "oot")) -> DataFrame:
    """In each stratum, md5 order cut at round-half-even of n times the cumulative ratio."""
    counts = df.groupBy(strata).agg(F.count("*").alias("__n"))
    ranked = global_rank(df.drop("split").withColumn("__h", md5_order(seed, key)), ["__h", key], [strata])
    parts = _parts(F.col("rank"), names, ratios, F.col("__n"), lambda c: F.bround(c))
    return ranked.join(counts, strata).withColumn("split", parts).drop("rank", "__h", "__n")


def window_bounds(token: str) -> tuple[str, str]:
    """First and last day of `2024-01`, `2024-01~2024-03` or `2024-01-05~2024-02-01`; compact dates are an error."""
    first, _, last = token.partition("~")
    last = last or first
    if any(len(x) not in (7, 10) or x[4] != "-" for x in (first, last)):
        raise ValueError(f"not a window: {token}")
    return first if len(first) == 10 else f"{first}-01", last if len(last) == 10 else f"{last}-31"


def split_by_windows(df: DataFrame, t: str, windows: dict[str, Sequence[str]], rest: str = "train") -> DataFrame:
    """The first split (train, validation, shadow_test, final_test) with a window over the day; uncovered rows go to train. No hit at all is an error."""
    day, split = F.date_format(t, "yyyy-MM-dd"), F.lit(None).cast("string")
    order = [s for s in ("train", "validation", "shadow_test", "final_test") if s in windows]
    for name in reversed(order):
        for token in windows[name]:
            first, last = window_bounds(token)
            split = F.when(day.between(first, last), name).otherwise(split)
    out = df.drop("split").withColumn("split", split)
    if out.filter("split IS NOT NULL").isEmpty():
        raise ValueError("no row is in any window")
    return out.withColumn("split", F.coalesce("split", F.lit(rest)))


def split_oot_then_random(df: DataFrame, t: str, window: tuple[str, str], ratios: dict[str, float], key: str, seed: int) -> DataFrame:
    """Days in [start, end) are oot, the others are split at random."""
    inside = (F.col(t) >= window[0]) & (F.col(t) < window[1])
    rest = split_random(df.filter(~F.coalesce(inside, F.lit(False))), ratios, key, seed)
    return rest.unionByName(df.drop("split").filter(inside).withColumn("split", F.lit("oot")))


def split_by_filters(df: DataFrame, train: str | None, test: str | None, oot: str | None = None) -> DataFrame:
    """Predicates; a missing train or test is what the other leaves. The first that holds counts (train, test, oot); rows of none go."""
    if train is None and test is None:
        raise ValueError("train or test is needed")
    left = F.expr(train) if train else ~F.expr(test)
    right = F.expr(test) if test else ~F.expr(train)
    split = F.when(left, "train").when(right, "test")
    if oot:
        split = F.when(F.expr(oot), "oot").when(left, "train").when(right, "test") if train is None or test is None else split.when(F.expr(oot), "oot")
    return df.drop("split").withColumn("split", split).filter("split IS NOT NULL")


def filter_audit(df: DataFrame, train: str, test: str, oot: str) -> DataFrame:
    """One row: rows, overlaps of each two predicates, share covered, low_coverage (under 95 %)."""
    a, b, c = (F.coalesce(F.expr(x), F.lit(False)) for x in (train, test, oot))
    out = df.agg(F.count("*").alias("rows"), F.count_if(a & b).alias("train_test"), F.count_if(a & c).alias("train_oot"), F.count_if(b & c).alias("test_oot"), F.avg((a | b | c).cast("double")).alias("coverage"))
    return out.withColumn("low_coverage", F.col("coverage") < 0.95)


def split_summary(df: DataFrame, label: str, dt: str) -> DataFrame:
    """split, rows, positives, rate, first and last day, share of all rows, and the largest gap of rates in points."""
    each = df.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(label).alias("rate"), F.min(dt).cast("string").alias("first_day"), F.max(dt).cast("string").alias("last_day"))
    all_ = Window.partitionBy()  # a row for each split
    return each.withColumn("share", F.col("rows") / F.sum("rows").over(all_)).withColumn("rate_gap", (F.max("rate").over(all_) - F.min("rate").over(all_)) * 100)


def validate_splits(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """split, rows, positives, negatives, ok (enough rows, both classes), warning."""
    y = F.col(label)
    each = df.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    ok = (F.col("rows") >= least) & (F.col("positives") > 0) & (F.col("negatives") > 0)
    small = F.when(F.col("rows") < 100, "under 100 rows")
    val = F.when((F.col("split") == "val") & ((F.col("rows") < 500) | (F.col("positives") < 30)), "small validation")
    train = F.when((F.col("split") == "train") & (F.col("rows") < 10_000), "under 10000 train rows")
    return each.withColumn("ok", ok).withColumn("warning", F.coalesce(small, val, train))


def order_within_day(df: DataFrame, t: str, id_: str) -> DataFrame:
    """df with rank: by time, then by a hash of time and id."""
    return global_rank(df.withColumn("__h", F.md5(F.concat_ws("|", F.col(t).cast("string"), F.col(id_).cast("string")))), [t, "__h", id_]).drop("__h")


def prefix_label_check(df: DataFrame, t: str, id_: str, label: str, share: float = 0.125) -> DataFrame:
    """One row: label rate of the first share of the ordered rows, and of all."""
    n = df.count()
    first = F.col("rank") < int(n * share)
    return order_within_day(df, t, id_).agg(F.count_if(first).alias("prefix_rows"), F.avg(F.when(first, F.col(label))).alias("prefix_rate"), F.avg(label).alias("rate"))


def systematic_sample(df: DataFrame, max_rows: int, order: Sequence[str], seed: int, without: Sequence[str] = ("final_test",)) -> DataFrame:
    """Of each split its share of max_rows, one row in each stride at a place fixed by a hash; every row if there are no more."""
    rows = df.filter(~F.col("split").isin(*without)) if without else df
    counts = rows.groupBy("split").agg(F.count("*").alias("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    counts = counts.withColumn("__m", F.when(F.col("__all") <= max_rows, F.col("__n")).otherwise(F.least("__n", F.bround(F.col("__n") * max_rows / F.col("__all")).cast("long"))))
    ranked = global_rank(rows, list(order), ["split"]).join(F.broadcast(counts), "split")
    i = F.floor(F.col("rank") * F.col("__m") / F.col("__n"))  # the stride that the row is in
    start, end = F.ceil(i * F.col("__n") / F.col("__m")), F.ceil((i + 1) * F.col("__n") / F.col("__m"))
    at = start + F.pmod(md5_number(seed, "split", "__i"), end - start)
    return ranked.withColumn("__i", i).filter(F.col("rank") == at).select(df.columns)


def seeded_subsamples(df: DataFrame, cap: int, seeds: Sequence[int], key: str) -> DataFrame:
    """df with seed: for each seed the cap rows with the smallest md5. df is read a few times, so it should be a stored table; only rows near each seed's border are ordered."""
    each = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return smallest_by_hash(each, F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col(key).cast("string"))), cap, key, F.col("seed"))


def time_segments(df: DataFrame, t: str, holdout: float = 0.15, es: float = 0.05) -> DataFrame:
    """df with segment fit, early_stop or holdout by time; borders lie between time values."""
    times = _by_time(df, t).select(t, _parts(F.col("before") / F.col("total"), ("fit", "early_stop", "holdout"), (1 - holdout - es, es, holdout)).alias("segment"))
    return df.join(times, t)


def kfold(df: DataFrame, k: int, key: str, seed: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(md5_number(seed, key), F.lit(k)))


def balanced_cases(df: DataFrame, label: str, n: int, key: str, seed: int) -> DataFrame:
    """n/2 rows of each class by md5 order; the first n rows by it if no row has a class. Doubles rounded to 4 digits."""
    classed = not df.filter(F.col(label).isin(0, 1)).isEmpty()
    side = F.when(F.col(label).isin(0, 1), F.col(label)) if classed else None
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return smallest_by_hash(df, md5_order(seed, key), n // 2 if classed else n, key, side).select(*rounded)
