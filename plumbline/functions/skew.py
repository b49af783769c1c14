"""Joins on keys that many rows share, and the smallest rows by a hash without a full order."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import global_rank

#: Slices of a partition's share of rows that a heavy key is cut into; more of them even out what tasks get.
SLICES = 16


def _same(columns: dict[str, str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in columns.items()])


def skewed_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """large joined with small (inner or left) on keys, of which a few may have a great part of large's rows.

    Rows of each key of large are counted (tasks add up theirs first). A key
    with more than a slice of a partition's share is heavy: large's rows of it are
    dealt over as many salts as slices, small's are repeated for each. There are
    at most SLICES heavy keys a partition, so they are sent to every task; all
    others are joined plainly. large is read twice, so it should be a stored
    table. Null keys match nothing; with a left join they are kept, and dealt too.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    parts = max(1, int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows or large.count()
    share = max(1, total // (parts * SLICES))
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    heavy = counts.filter(F.col("__n") > share).select(*[F.col(k).alias(v) for k, v in named.items()], F.ceil(F.col("__n") / share).cast("int").alias("__salts"))
    kept = heavy.collect()  # at most SLICES for each partition
    if not kept:
        return large.join(small, list(keys), how)
    heavy = F.broadcast(large.sparkSession.createDataFrame(kept, heavy.schema))
    salted = large.join(heavy, _same(named), "left").withColumn("__salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts", *named.values())
    copies = small.join(heavy, _same(named), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts", *named.values())
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def smallest_by_hash(df: DataFrame, hashed: Column, k: int, key: str, group: Column | None = None) -> DataFrame:
    """Of each group the k rows with the smallest hash (hexadecimal text, all of one length), ties by key; rows without a group are left out.

    Rows are counted by the first three digits of the hash, then by three more of
    those at the border, until few are left there: only they are ordered. df is
    read a few times, so it should be a stored table; groups are few.
    """
    rows = df.withColumn("__hash", hashed).withColumn("__group", F.lit("") if group is None else group.cast("string")).filter("__group IS NOT NULL")
    state = {None: ("", 0)}  # group: the prefix in which its k-th row is, rows below it
    done: dict[str, tuple[str, int]] = {}
    depth = 0
    while state:
        depth += 3
        wanted = F.lit(True) if depth == 3 else functools.reduce(lambda a, b: a | b, [(F.col("__group") == g) & F.col("__hash").startswith(p) for g, (p, _) in state.items()])
        found = rows.filter(wanted).groupBy("__group", F.substring("__hash", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4096 for each group
        each: dict[str, list] = {}
        for r in found:
            each.setdefault(r["__group"], []).append((r.p, r.n))
        nexts = {}
        for g, cells in each.items():
            below = 0 if depth == 3 else state[g][1]
            for p, n in sorted(cells):
                if below + n >= k:
                    (done if n <= max(1000, 2 * k) or depth >= 30 else nexts)[g] = (p, below)
                    break
                below += n
            else:
                done[g] = ("~", below)  # fewer than k rows: all
        state = nexts
    if not done:
        return rows.limit(0).drop("__hash", "__group")
    bounds = df.sparkSession.createDataFrame([(g, p, k - below) for g, (p, below) in done.items()], "__group string, __prefix string, __wanted long")
    near = rows.join(F.broadcast(bounds), "__group").withColumn("__start", F.expr("substring(__hash, 1, length(__prefix))"))
    sure = near.filter(F.col("__start") < F.col("__prefix"))
    edge = global_rank(near.filter(F.col("__start") == F.col("__prefix")), ["__hash", key], ["__group"], "__place").filter(F.col("__place") < F.col("__wanted")).drop("__place")
    return sure.unionByName(edge).drop("__hash", "__group", "__prefix", "__wanted", "__start")
