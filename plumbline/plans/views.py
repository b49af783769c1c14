"""The labelled sample and its long form, on the given tables, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.primitives import melt, over

NUMERIC = ["c_acctbal", "n_lines", "sum_qty", "avg_disc", "signed", "const_f", "sparse_f"]
CATEGORICAL = ["c_mktsegment", "o_orderpriority"]
RANGES = [("train", "1995-01-01", "1998-12-31"), ("test", "1999-01-01", "1999-12-31"), ("oot", "2000-01-01", "2001-12-31")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: key, day, label, arm, outcome, features with real nulls, scores with ties, split."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    orders = read(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    id_ = F.col("id")
    day = F.to_date("o_orderdate")
    return orders.join(customer, "o_custkey", "left").join(lines, "id", "left").select(
        "id", "o_custkey", day.alias("dt"), F.date_format("o_orderdate", "yyyyMMdd").alias("pday"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("int").alias("arm"),
        F.col("o_totalprice").alias("outcome"), "c_acctbal", "n_lines", "sum_qty", "avg_disc", "c_mktsegment", "o_orderpriority",
        (F.col("c_acctbal") - 4000).alias("signed"), F.lit(1.0).alias("const_f"),
        F.when(id_ % 20 == 0, (id_ % 7).cast("double")).alias("sparse_f"),
        ((id_ * 7919) % 1000 / 1000.0).alias("score"), ((id_ * 104729) % 1000 / 1000.0).alias("score_old"),
        (((id_ * 31) % 2001 - 1000) / 1000.0).alias("cate"),
        F.when(day < "1999-01-01", "train").when(day < "2000-01-01", "test").otherwise("oot").alias("split"),
    )


SAMPLE = """
lines AS (SELECT l_orderkey AS id, count(*) AS n_lines, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1),
sample AS (
    SELECT o.o_orderkey AS id, o.o_custkey, CAST(o_orderdate AS DATE) AS dt, strftime(o_orderdate, '%Y%m%d') AS pday,
           CAST(o_orderstatus = 'F' AS INT) AS label, CAST(left(o_orderpriority, 1) IN ('1', '2') AS INT) AS arm, o_totalprice AS outcome,
           c_acctbal, n_lines, sum_qty, avg_disc, c_mktsegment, o_orderpriority, c_acctbal - 4000 AS signed, CAST(1 AS DOUBLE) AS const_f,
           CASE WHEN o.o_orderkey % 20 = 0 THEN CAST(o.o_orderkey % 7 AS DOUBLE) END AS sparse_f,
           (o.o_orderkey * 7919) % 1000 / CAST(1000 AS DOUBLE) AS score, (o.o_orderkey * 104729) % 1000 / CAST(1000 AS DOUBLE) AS score_old,
           ((o.o_orderkey * 31) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS cate,
           CASE WHEN o_orderdate < '1999-01-01' THEN 'train' WHEN o_orderdate < '2000-01-01' THEN 'test' ELSE 'oot' END AS split
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN lines l ON l.id = o.o_orderkey)"""

_NAMES = ", ".join(f"'{f}'" for f in NUMERIC)
_VALUES = ", ".join(f"CAST({f} AS DOUBLE)" for f in NUMERIC)
LONG = f"{SAMPLE},\nlong AS (SELECT * EXCLUDE ({', '.join(NUMERIC)}), unnest([{_NAMES}]) AS feature, unnest([{_VALUES}]) AS value FROM sample)"
_CATS = ", ".join(f"'{f}'" for f in CATEGORICAL)
CATS = f"{SAMPLE},\ncats AS (SELECT * EXCLUDE ({', '.join(CATEGORICAL)}), unnest([{_CATS}]) AS feature, unnest([{', '.join(CATEGORICAL)}]) AS value FROM sample)"


def long_sample(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("id", "label", "arm", "split", "dt")) -> DataFrame:
    return melt(sample(spark, sf_dir), NUMERIC, keep)


def over_sample(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(sample) with the sample's columns that profiles need stored once."""
    return over(sample(spark, sf_dir).select("id", "label", "arm", "outcome", "split", "score", *NUMERIC, *CATEGORICAL), make, "sample")


def over_columns(spark: SparkSession, sf_dir: str, keep: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(sample) with keep and the numeric features stored once."""
    return over(sample(spark, sf_dir).select(*keep, *NUMERIC), make, "sample")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, seq: the event types of a user's day in order of time, joined by commas."""
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return events.groupBy("user_id", "day").agg(seq.alias("seq"))


TOKENS = "tokens AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, ',' ORDER BY ts, event_id) AS seq FROM events GROUP BY 1, 2)"
