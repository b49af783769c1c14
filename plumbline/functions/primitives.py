"""Building blocks: long form, bins by edges, hash order, global ranks and prefix sums."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, a new temporary one if all runs on one machine, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("plumbline.shared.dir", folder)
    return folder


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema, cleanup = df.schema, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # shuffle files of a table that is written are not needed again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def over(df: DataFrame, make: Callable[[DataFrame], DataFrame], name: str = "rows") -> DataFrame:
    """make(df) with df written once, however often make reads it; the result is a table, and the rows are deleted. For small results."""
    rows = written(df, name)
    try:
        return written(make(rows), f"{name}-result")
    finally:
        discard(rows)


def number(c: Column | str) -> Column:
    """As double; NaN is null."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(d), d)


def spread(of: Callable[[Column], Column], c: Column | str) -> Column:
    """A variance or deviation that is exactly 0 where all values are equal; Spark's own may not be, as means of partial counts are rounded when they are merged."""
    return of(c) * F.when(F.min(c) == F.max(c), 0.0).otherwise(1.0)


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), text: bool = False) -> DataFrame:
    """keep, feature, value: one row for each row and feature; values as double, or as string."""
    value = (lambda f: F.col(f).cast("string")) if text else number
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_")).select(*keep, "_.feature", "_.value")


def quantiles(long: DataFrame, at: Sequence[float], by: Sequence[str] = ("feature",), value: str = "value", times: str | None = None) -> DataFrame:
    """by, q: exact linear quantiles of the non-null values at the shares; null without values.

    Values are counted, brought in order over many tasks, and those on both
    sides of each quantile's place are picked: no task holds the values of a
    group. times: a column of how often each row counts. Groups are few.
    """
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = long.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(n.alias("__c"))
    ranked = prefix_sums(counts, ["__v"], {"__upto": F.col("__c")}, by, None)
    named = {g: f"__g{k}" for k, g in enumerate(by)}
    same = lambda right: functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(right[k]) for g, k in named.items()], F.lit(True))
    sizes = ranked.groupBy(*by).agg(F.max("__upto").alias("__n")).withColumnsRenamed(named)
    joined = ranked.join(sizes, same(sizes))
    picked, places = [], []
    for k, share in enumerate(at):
        place = F.lit(float(share)) * (F.col("__n") - 1)
        low, high = F.floor(place), F.ceil(place)
        picks = lambda r: F.max(F.when((r >= F.col("__upto") - F.col("__c")) & (r < F.col("__upto")), F.col("__v")))
        picked += [picks(low).alias(f"__l{k}"), picks(high).alias(f"__h{k}")]
        a, b = F.col(f"__l{k}"), F.col(f"__h{k}")
        places.append(F.when(a == b, a).otherwise((high - place) * a + (place - low) * b))
    found = joined.groupBy(*by, "__n").agg(*picked).select(*by, F.array(*places).alias("q")).withColumnsRenamed(named)
    groups = long.select(*by).distinct()
    return groups.join(found, same(found), "left").select(*by, "q")


def quantile_edges(long: DataFrame, n_bins: int, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """by, edges: distinct linear quantiles of the non-null values, outer ones included; null without values."""
    found = quantiles(long, [k / n_bins for k in range(n_bins + 1)], by, value)
    return found.select(*by, F.array_distinct(F.transform("q", lambda x: F.round(x, 9))).alias("edges"))


def inner(edges: Column) -> Column:
    """Edges without the first and last, which open to infinity."""
    return F.when(F.size(edges) > 2, F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))).otherwise(F.array().cast("array<double>"))


def bin_index(value: Column, borders: Column, closed: str = "right") -> Column:
    """Number of borders below value (right-closed bins) or up to it (left-closed)."""
    return F.size(F.filter(borders, lambda e: (e < value) if closed == "right" else (e <= value)))


def md5_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def md5_number(seed: int | str, *keys: str) -> Column:
    """A fixed number below 2 ** 32 for each key."""
    return F.conv(F.substring(md5_order(seed, *keys), 1, 8), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column] | None = None, groups: Sequence[str] = (), rank: str | None = "rank") -> DataFrame:
    """Running sums and the 0-based rank of every row in a global order, within groups, on many tasks.

    Rows are dealt by range, written, and summed in two steps: within each
    part, and over the parts before it. order: column names, those that fall
    with a minus before them. It must be unique (end it with the row key), or
    equal rows share sums in no fixed order.
    """
    sums = {k: F.coalesce(v, F.lit(0)) for k, v in (sums or {}).items()}
    keys = [F.col(g) for g in groups]
    kept = df.columns
    marked = df.select("*", *[v.alias(f"__s_{k}") for k, v in sums.items()])
    ordered = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in order]
    dealt = marked.repartitionByRange(*keys, *ordered).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    totals = dealt.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = totals.select(*groups, "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("__n", *[f"__t_{k}" for k in sums])])
    offsets = offsets.withColumnsRenamed({g: f"__g{k}" for k, g in enumerate(groups)} | {"__part": "__p"})
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    joined = dealt.join(offsets if groups else F.broadcast(offsets), same)  # without groups: a row for each part
    here = Window.partitionBy(*groups, "__part").orderBy(*ordered)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    out = [(F.sum(f"__s_{k}").over(upto) + F.col(f"__b__t_{k}")).alias(k) for k in sums]
    if rank:
        out.append((F.row_number().over(here) - 1 + F.col("__b__n")).cast("long").alias(rank))
    return joined.select(*kept, *out)


def global_rank(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    return prefix_sums(df, order, {}, groups, name)
