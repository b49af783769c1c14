"""Sources and sinks: samples and feature tables from files, wide fetches, split planes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.primitives import discard, written


def read_sample(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet or CSV (header, byte order mark dropped) by the extension; a folder of files counts as Parquet unless it is named .csv."""
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.rstrip("/").endswith(".csv") for p in paths):
        df = spark.read.csv(paths, header=True, inferSchema=True, encoding="UTF-8")
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if any(p.endswith((".csv", ".json", ".txt", ".xlsx")) for p in paths):
        raise ValueError(f"neither Parquet nor CSV alone: {paths}")
    return spark.read.parquet(*paths)


def decimals_as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema])


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet shards as one table, columns by name, empty shards welcome; decimals become double at the scan."""
    return decimals_as_double(spark.read.option("mergeSchema", "true").parquet(*paths))


def fetch_wide(df: DataFrame, dt_col: str, start: str, end: str, label_expr: str | None, id_cols: Sequence[str], features: Sequence[str], where: str | None = None) -> DataFrame:
    """Rows of the closed window (and cohort): ids, features, date without repeats, and the label expression as label."""
    rows = df.where(F.col(dt_col).between(start, end))
    if where:
        rows = rows.where(F.expr(where))
    columns: list[Column] = [F.col(c) for c in dict.fromkeys([*id_cols, *features, dt_col])]
    return rows.select(*columns, *([F.expr(label_expr).alias("label")] if label_expr else []))


def fetch_sample_features(sample: DataFrame, features: DataFrame, keys: Sequence[str], dt_col: str, start: str, end: str, lag_day: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """The sample with feature columns by keys; with lag_day 1, those of the day before. Dates are yyyyMMdd strings; both sides are cut to the window before the join."""
    if lag_day not in (0, 1):
        raise ValueError("lag_day is 0 or 1")
    if lag_day and dt_col not in keys:
        raise ValueError("a lagged join needs the date as a key")
    day = lambda s, n: F.date_format(F.date_add(F.to_date(s, "yyyyMMdd"), n), "yyyyMMdd")
    columns = [c for c in (columns or features.columns) if c not in keys]
    right = features.where(F.col(dt_col).between(day(F.lit(start), -lag_day), day(F.lit(end), -lag_day)))
    right = right.select(*keys, *columns)
    if lag_day:
        right = right.withColumn(dt_col, day(F.col(dt_col), 1))
    return sample.where(F.col(dt_col).between(start, end)).join(right, list(keys), "left")


def derive_feature_list(df: DataFrame, exclude: Sequence[str], allow: Sequence[str] | None = None) -> DataFrame:
    """feature, position, status: columns outside exclude, in order; with an allow list, kept ones and missing ones. Reads no data."""
    have = [c for c in df.columns if c not in set(exclude)]
    names = have if allow is None else list(dict.fromkeys(allow))
    rows = [(f, k, "kept" if f in set(have) else "missing") for k, f in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature string, position long, status string")


def assert_plane_clean(df: DataFrame, banned: Sequence[str]) -> DataFrame:
    """df, or an error if a banned column reached it."""
    if found := sorted(set(df.columns) & set(banned)):
        raise ValueError(f"banned columns in the output: {found}")
    return df


def write_splits(df: DataFrame, out: str, key: str, time: str, label: str, text: Sequence[str] = (), banned: Sequence[str] = ()) -> dict[str, str]:
    """Four planes under out (features, labels, identity, text), each partitioned by split; labels of final_test are not stored.

    What df is made of is computed and read once: its rows are written aside, and
    each plane reads the columns it has of them.
    """
    features = [c for c in df.columns if c not in {key, time, label, "split", *text, *banned}]
    df = written(df, "planes")
    planes = {
        "features": df.select(key, *features, "split"), "labels": df.where("split <> 'final_test'").select(key, label, "split"),
        "identity": df.select(key, time, "split"), "text": df.select(key, *text, "split"),
    }
    for name, plane in planes.items():
        hidden = [label] if name != "labels" else []
        assert_plane_clean(plane, [*banned, *hidden]).write.partitionBy("split").mode("overwrite").parquet(f"{out}/{name}")
    discard(df)
    return {name: f"{out}/{name}" for name in planes}


def read_plane(spark: SparkSession, out: str, plane: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{out}/{plane}")
    return df.where(F.col("split") == split) if split else df


def write_table(df: DataFrame, path: str) -> None:
    """Overwrites path: CSV with a header if it ends so, else Parquet."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if path.endswith(".csv") else writer.parquet(path)
