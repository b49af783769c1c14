"""Rank correlations of many columns with many others, by products of blocks of ranks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import wide
from plumbline.functions.primitives import discard, written

#: Cells and rows of a block of rows, at most; values of a column that are ordered in one group, about; rows and columns of a tile.
BLOCK_CELLS, BLOCK_ROWS, GROUP_VALUES, TILE = 4 << 20, 1 << 16, 1_000_000, 128
#: Bytes of packed columns of blocks that are read or sent to Python at a time, at most.
BATCH_BYTES = 32 << 20
_BATCH, _READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Of each pair of columns, over rows where both are there: rows, sums, squares and products of ranks.
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _block_rows(columns: int) -> int:
    return max(256, min(BLOCK_ROWS, BLOCK_CELLS // columns))


@contextmanager
def _batches(spark: SparkSession, **rows: int) -> Iterator[None]:
    """Actions in it read (_READ) and send to Python (_BATCH) so many rows at a time."""
    before = {k: spark.conf.get(k) for k in rows}
    for k, n in rows.items():
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, n in before.items():
            spark.conf.set(k, n)


def _few(spark: SparkSession, columns: int):
    """For actions on ranked blocks: a row of them may have a value of 8 and a place of 4 bytes for each row of its block, and Spark's own batches have thousands of rows."""
    n = max(4, min(4096, BATCH_BYTES // (12 * _block_rows(columns))))
    return _batches(spark, **{_BATCH: n, _READ: n})


def _blocks(df: DataFrame, columns: Mapping[str, str], borders: list[np.ndarray], base: list[np.ndarray], group: list[np.ndarray]) -> DataFrame:
    """block, size, feature, part, ranks, values, places: of each block of rows and column the ranks that are known (part -1), and the values that are to be ordered, by part, with their places among the size rows of the block.

    A value that is a border has a known rank; ranks are counted from the middle of the column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            spot = lambda at: at.astype(np.int32).tobytes()
            for k, column in enumerate(batch.columns):
                v = np.asarray(column.to_numpy(zero_copy_only=False), np.float64)
                there = ~np.isnan(v)
                code = np.searchsorted(borders[k], v, "left") + np.searchsorted(borders[k], v, "right")
                known, open_ = np.flatnonzero(there & (code % 2 == 1)), np.flatnonzero(there & (code % 2 == 0))
                part = group[k][code[open_]]
                order = np.argsort(part, kind="stable")
                parts, starts = np.unique(part[order], return_index=True)
                rows = [(-1, base[k][code[known]].tobytes(), None, spot(known))]
                rows += [(p, None, v[at].tobytes(), spot(at)) for p, at in zip(parts.tolist(), np.split(open_[order], starts[1:]), strict=False)]
                for p, *data in rows:
                    for held, x in zip(out, (k, p, *data), strict=True):
                        held.append(x)
            heads = [pa.array([block] * len(out[0]), pa.int64()), pa.array([batch.num_rows] * len(out[0]), pa.int32()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32())]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(x, pa.binary()) for x in out[2:]]], ["block", "size", "feature", "part", "ranks", "values", "places"])
            block += 1

    rows = df.selectExpr(*[f"CAST({c} AS DOUBLE) AS v{k}" for k, c in enumerate(columns.values())])
    with _batches(df.sparkSession, **{_BATCH: _block_rows(len(columns))}):
        return written(rows.mapInArrow(run, "block long, size int, feature int, part int, ranks binary, values binary, places binary"), "rank-blocks")


def ranked_blocks(df: DataFrame, columns: Mapping[str, str]) -> tuple[DataFrame, list[DataFrame]]:
    """block, size, feature, ranks, places: average ranks of each column, for each block of rows, and the tables to discard afterwards. To be read within _few.

    Two scans count the values at and between borders near the quantiles; the
    values of a stretch between borders are ordered in one group and their
    ranks sent back to their block. What moves is packed: a row for each
    block and column, and values that many rows share not at all.
    """
    about = wide.moments(df, columns)
    borders = [np.unique(np.asarray(about[f]["borders"][::4], np.float64)) + 0.0 for f in columns]  # a value of a 64th of the rows is one
    base, group, starts = [], [], []
    counted = {}
    for at in range(0, len(columns), wide.BLOCK):
        some = list(columns)[at : at + wide.BLOCK]
        for r in wide.border_counts(df, {str(at + k): columns[f] for k, f in enumerate(some)}, {str(at + k): borders[at + k] for k in range(len(some))}).collect():  # a row for each column
            counted[int(r.feature)] = np.array(r.codes, np.int64)
    for k in range(len(columns)):
        codes = counted.get(k, np.zeros(1, np.int64))[: 2 * len(borders[k]) + 1]
        before, middle = np.cumsum(codes) - codes, (codes.sum() + 1) / 2
        base.append(before + (codes + 1) / 2 - middle)  # of a border: the mean rank of its rows
        group.append((np.cumsum(np.where(np.arange(len(codes)) % 2, 0, codes)) // GROUP_VALUES).astype(np.int32))
        starts.append(before - middle)
    blocks = _blocks(df, columns, borders, base, group)

    def order(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        values = [np.frombuffer(v.as_py(), np.float64) for v in rows["values"]]
        whole = np.concatenate(values)
        distinct, at, counts = np.unique(whole, return_inverse=True, return_counts=True)
        upto = np.cumsum(counts)
        code = 2 * np.searchsorted(borders[k], distinct, "left")
        first = np.searchsorted(code, code)  # of the same stretch
        within = upto - (upto - counts)[first] - (counts - 1) / 2
        ranks = (starts[k][code] + within)[at]
        ends = np.cumsum([len(v) for v in values])
        return pa.table({"block": rows["block"], "size": rows["size"], "feature": rows["feature"], "ranks": pa.array([r.tobytes() for r in np.split(ranks, ends[:-1])], pa.binary()), "places": rows["places"]})

    ordered = blocks.filter("part >= 0").groupBy("feature", "part").applyInArrow(order, "block long, size int, feature int, ranks binary, places binary")
    known = blocks.filter("part = -1").select("block", "size", "feature", "ranks", "places")
    return known.unionByName(ordered), [blocks]


def _products(n_x: int, n_y: int):
    """Sums over the rows of a task for all pairs of the first n_x columns and the n_y after them, in tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, n_x, n_y))
        block, ranks = None, np.empty((0, 0))

        def add() -> None:
            there = ~np.isnan(ranks)
            filled = np.where(there, ranks, 0)
            x, y, a, b = filled[:n_x], filled[n_x:].T, there[:n_x].astype(float), there[n_x:].T.astype(float)
            for k, (p, q) in enumerate(((a, b), (x, b), (a, y), (x * x, b), (a, y * y), (x, y))):
                sums[k] += p @ q

        for batch in batches:
            for of, size, feature, data, places in zip(*[batch.column(c).to_pylist() for c in ("block", "size", "feature", "ranks", "places")], strict=True):
                if of != block:
                    if block is not None:
                        add()
                    block, ranks = of, np.full((n_x + n_y, size), np.nan)
                ranks[feature, np.frombuffer(places, np.int32)] = np.frombuffer(data, np.float64)
        if block is not None:
            add()
            lane = TaskContext.get().partitionId() % 32
            for i in range(0, n_x, TILE):
                for j in range(0, n_y, TILE):
                    tile = np.ascontiguousarray(sums[:, i : i + TILE, j : j + TILE])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([lane], pa.int32()), pa.array([tile.tobytes()], pa.binary())], ["i", "j", "lane", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(s.as_py(), np.float64) for s in rows["sums"]], axis=0)
    return rows.slice(0, 1).set_column(rows.column_names.index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))


def nearest_ranked(df: DataFrame, candidates: Sequence[str], reference: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """feature, nearest, corr: of each candidate the reference column with the largest absolute rank correlation, rounded to 9 digits (ties: the last name).

    Ranks are those in the whole column, ties share their mean. fill replaces
    nulls before ranking; with None, rows where a side is null are left out of a
    pair. Pairs without spread, and of a column with itself, don't count.
    Columns are read by some narrow scans, so df should be a stored table.
    """
    text = lambda c: wide.quoted(c) if fill is None else f"coalesce(nanvl(CAST({wide.quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE)), {float(fill)!r}D)"
    columns = {("x", c): text(c) for c in candidates} | {("y", r): text(r) for r in reference}
    n_x, n_y = len(candidates), len(reference)
    ranks, held = ranked_blocks(df, columns)
    dealt = ranks.repartition("block").sortWithinPartitions("block")
    tiles = dealt.mapInArrow(_products(n_x, n_y), "i int, j int, lane int, sums binary")
    tiles = tiles.groupBy("i", "j", "lane").applyInArrow(_added, tiles.schema).groupBy("i", "j").applyInArrow(_added, tiles.schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*[batch.column(c).to_pylist() for c in ("i", "j", "sums")], strict=True):
                xs, ys = candidates[i : i + TILE], reference[j : j + TILE]
                n, x, y, xx, yy, xy = np.frombuffer(data, np.float64).reshape(6, len(xs), len(ys))
                with np.errstate(divide="ignore", invalid="ignore"):
                    spread = np.sqrt(np.maximum(xx / n - (x / n) ** 2, 0) * np.maximum(yy / n - (y / n) ** 2, 0))
                    corr = np.where(spread > 1e-9, np.abs(xy / n - x * y / n / n) / spread, np.nan)
                corr = np.round(corr, 9)
                corr[np.array(xs)[:, None] == np.array(ys)] = np.nan
                found = [max(((c, r) for c, r in zip(row, ys, strict=True) if not np.isnan(c)), default=None) for row in corr.tolist()]
                kept = [(f, r, c) for f, hit in zip(xs, found, strict=True) if hit for c, r in [hit]]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string()), pa.array([k[2] for k in kept], pa.float64())], ["feature", "nearest", "corr"])

    each = tiles.mapInArrow(best, "feature string, nearest string, corr double")
    with _few(df.sparkSession, len(columns)):
        out = written(each.groupBy("feature").agg(F.max(F.struct("corr", "nearest")).alias("b")).select("feature", "b.nearest", "b.corr"), "nearest")  # a row for each candidate
    discard(*held)
    return out


def target_spearman(df: DataFrame, features: Sequence[str], target: str, least: int = 10) -> DataFrame:
    """feature, n, spearman: absolute rank correlation of each column with the target over rows where both are there; null under least rows or without spread.

    The target is ranked among the rows of each column; columns that are always
    there share its ranks. NaN is missing. df should be a stored table.
    """
    text = lambda c: f"nanvl(CAST({wide.quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    out = []
    for at in range(0, len(features), TILE // 2):
        some = list(features[at : at + TILE // 2])
        sizes = df.selectExpr(f"count({text(target)})", *[f"count(CASE WHEN {text(target)} IS NOT NULL THEN {text(f)} END)" for f in some]).first()
        xs = {("x", f): f"CASE WHEN {text(target)} IS NOT NULL THEN {text(f)} END" for f in some}
        ys = {("y", f if n < sizes[0] else None): f"CASE WHEN {text(f)} IS NOT NULL THEN {text(target)} END" if n < sizes[0] else text(target) for f, n in zip(some, sizes[1:], strict=True)}
        ranks, held = ranked_blocks(df, xs | ys)
        dealt = ranks.repartition("block").sortWithinPartitions("block")
        tiles = dealt.mapInArrow(_products(len(xs), len(ys)), "i int, j int, lane int, sums binary")
        with _few(df.sparkSession, len(xs) + len(ys)):
            found = tiles.groupBy("i", "j", "lane").applyInArrow(_added, tiles.schema).groupBy("i", "j").applyInArrow(_added, tiles.schema).collect()  # one tile
        discard(*held)
        for r in found:
            sums, order = np.frombuffer(r.sums, np.float64).reshape(6, len(xs), len(ys)), list(ys)
            for k, (f, size) in enumerate(zip(some, sizes[1:], strict=True)):
                n, x, y, xx, yy, xy = sums[:, k, order.index(("y", f if size < sizes[0] else None))].tolist()
                if n:
                    spread = (max(xx / n - (x / n) ** 2, 0) * max(yy / n - (y / n) ** 2, 0)) ** 0.5
                    out.append((f, int(n), abs(xy / n - x * y / n / n) / spread if spread > 1e-9 and n >= least else None))
    return df.sparkSession.createDataFrame(out, "feature string, n long, spearman double")
