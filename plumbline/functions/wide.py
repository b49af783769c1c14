"""Statistics of many columns by narrow scans: no row for each cell, no shuffle of cells.

A scan reads the columns in blocks as Arrow batches; each task gives a row of
sums for each column. What comes back to the driver is a few numbers for each
column. Values are taken as doubles; null and NaN are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that one task reads together; order statistics that a task keeps of a column.
BLOCK, SKETCH = 128, 64
#: Values of a column between two borders that are sorted at last; borders tried for each rank in a scan.
REST, TRIES = 4096, 4
#: Bytes of distinct values that a task gathers before it sends them on, those from which it adds up equal ones, and distinct values that one group holds, about.
HELD_BYTES, SUMMED_BYTES, GROUP_VALUES = 32 << 20, 2 << 20, 1_000_000


def as_columns(features: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """Names with the SQL expression of each; thousands of them are made faster as text than as columns."""
    return dict(features) if isinstance(features, Mapping) else {f: quoted(f) for f in features}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scan(df: DataFrame, columns: Mapping[str, str], run: Callable, schema: str, keep: Column | None = None) -> DataFrame:
    """The rows that run(first, batches) gives; a batch is (values by column and row, kept columns), first the number of its first column."""
    parts, names = [], list(columns)
    if keep is not None:
        df = df.withColumn("__kept", keep.cast("double"))
    for first in range(0, len(names), BLOCK):
        block = names[first : first + BLOCK]
        rows = df.selectExpr(*["__kept"] * (keep is not None), *[f"CAST({columns[f]} AS DOUBLE) AS v{k}" for k, f in enumerate(block)])

        def task(batches: Iterator[pa.RecordBatch], first: int = first, n: int = len(block)) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
                for batch in batches:
                    of = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                    yield of[len(of) - n :], of[: len(of) - n]

            yield from run(first, n, each())

        parts.append(rows.mapInArrow(task, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _present(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, np.float64)
    return values[~np.isnan(values)]


def moments(df: DataFrame, features: Sequence[str] | Mapping[str, str]) -> dict[str, dict]:
    """Of each column: rows, n, mean, m2 (sum of squared distances from it), min, max, borders (values near its quantiles, in order).

    One scan. Borders are order statistics of the tasks' order statistics.
    """
    columns = as_columns(features)

    def run(first: int, n: int, batches) -> Iterator[pa.RecordBatch]:
        rows, count, mean, m2 = 0, np.zeros(n), np.zeros(n), np.zeros(n)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        held: list[list[np.ndarray]] = [[] for _ in range(n)]
        for values, _ in batches:
            rows += len(values[0])
            for k, v in enumerate(values):
                v = _present(v)
                if not len(v):
                    continue
                own, c = v.mean(), len(v)
                gap, total = own - mean[k], count[k] + c
                m2[k] += ((v - own) ** 2).sum() + gap * gap * count[k] * c / total
                mean[k] += gap * c / total
                count[k] = total
                v = np.sort(v)
                low[k], high[k] = min(low[k], v[0]), max(high[k], v[-1])
                held[k].append(v[np.linspace(0, c - 1, min(c, SKETCH)).astype(np.int64)])
                if len(held[k]) > 32:
                    held[k] = [_thin(held[k])]
        if rows:
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(range(first, first + n), pa.int32()), "rows": pa.array([rows] * n, pa.int64()), "n": pa.array(count.astype(np.int64)), "mean": pa.array(mean), "m2": pa.array(m2),
                "low": pa.array(low), "high": pa.array(high), "some": pa.array([_thin(h) if h else np.empty(0) for h in held], pa.list_(pa.float64())),
            })

    found = scan(df, columns, run, "feature int, rows long, n long, mean double, m2 double, low double, high double, some array<double>")
    shares = [k / 256 for k in range(257)]
    state = F.struct(F.col("n").cast("double").alias("n"), "mean", "m2")

    def merge(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        joined = F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(joined)

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    few = found.groupBy("feature", F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane")).agg(  # two steps: a list has a row for each task of a lane
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.aggregate(F.collect_list(state), zero, merge).alias("state"), F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_list("some")).alias("some")
    )
    totals = few.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.aggregate(F.collect_list("state"), zero, merge).alias("state"), F.min("low").alias("low"), F.max("high").alias("high"))
    borders = few.select("feature", F.explode("some").alias("v")).groupBy("feature").agg(F.percentile_approx("v", shares, 5000).alias("borders"))
    names, out = list(columns), {f: {"rows": 0, "n": 0, "mean": None, "m2": None, "min": None, "max": None, "borders": []} for f in columns}
    for r in totals.join(borders, "feature", "left").collect():  # a row for each column
        if r.n:
            out[names[r.feature]] = {"rows": r["rows"], "n": r.n, "mean": r.state.mean, "m2": r.state.m2, "min": r.low, "max": r.high, "borders": r.borders}
        else:
            out[names[r.feature]]["rows"] = r["rows"]
    return out


def _thin(parts: list[np.ndarray]) -> np.ndarray:
    v = np.sort(np.concatenate(parts))
    return v[np.linspace(0, len(v) - 1, min(len(v), SKETCH)).astype(np.int64)]


def border_counts(df: DataFrame, features: Sequence[str] | Mapping[str, str], borders: Mapping[str, Sequence[float]], classes: Column | None = None, n_classes: int = 1) -> DataFrame:
    """feature, class, missing, codes: how many values of a class are missing, and how many are where by the borders (in rising order).

    One scan. codes[2 j] counts values between border j - 1 and border j,
    codes[2 j + 1] those equal to border j. classes: whole numbers below
    n_classes; rows where it is null are left out. A class without rows has none.
    """
    columns = as_columns(features)
    names, width = list(columns), 2 * max([0, *[len(borders.get(f, ())) for f in columns]]) + 1
    held = [np.asarray(borders.get(f, ()), np.float64) for f in names]

    def run(first: int, n: int, batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, n_classes, width + 1), np.int64)
        for values, keep in batches:
            kind = np.asarray(keep[0], np.float64)
            used = ~np.isnan(kind)
            kind = np.where(used, kind, 0).astype(np.int64)
            for k, v in enumerate(values):
                v = np.asarray(v, np.float64)
                code = np.searchsorted(held[first + k], v, "left") + np.searchsorted(held[first + k], v, "right")
                code = np.where(np.isnan(v), width, code)
                counts[k] += np.bincount((kind * (width + 1) + code)[used], minlength=n_classes * (width + 1)).reshape(n_classes, width + 1)
        at = np.argwhere(counts.any(2))
        if len(at):
            some = counts[at[:, 0], at[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0] + first, pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(list(some), pa.list_(pa.int64()))], ["feature", "class", "c"])

    one = F.lit(0) if classes is None else classes
    found = scan(df, columns, run, "feature int, class int, c array<long>", one)
    summed = found.groupBy("feature", "class").agg(*[F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(width + 1)])
    numbered = df.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    return summed.join(F.broadcast(numbered), "feature").select(F.col("name").alias("feature"), "class", F.col(f"c{width}").alias("missing"), F.array(*[f"c{k}" for k in range(width)]).alias("codes"))


def _key(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of doubles; both zeros are one."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: np.ndarray) -> np.ndarray:
    return np.where(key >> np.uint64(63), key & np.uint64((1 << 63) - 1), ~key).astype(np.uint64).view(np.float64)


class _Search:
    """Where the values of some ranks of one column are: between low and high, of which below are up to low."""

    def __init__(self, about: dict, ranks: set[int]):
        self.found: dict[int, float] = {}
        self.n, low, high = about["n"], _key(np.array([about["min"]]))[0], _key(np.array([about["max"]]))[0]
        self.open = {r: (int(low) - 1, int(high) + 1, 0, self.n) for r in ranks}
        near = about["borders"]
        self.borders = sorted({near[min(max(round(256 * r / self.n) + d, 0), 256)] for r in ranks for d in (-2, -1, 0, 1, 2)})

    def narrow(self, codes: Sequence[int]) -> None:
        """Takes in how many values are between and at the borders."""
        upto = np.cumsum(codes)
        for j, border in enumerate(self.borders):
            below, through, key = int(upto[2 * j]), int(upto[2 * j + 1]), int(_key(np.array([border]))[0])
            for r, (low, high, a, b) in list(self.open.items()):
                if below <= r < through:
                    self.found[r] = border
                    del self.open[r]
                elif through <= r and key > low:
                    self.open[r] = (key, high, through, b)
                elif r < below and key < high:
                    self.open[r] = (low, key, a, below)
        wide = {(low, high) for low, high, a, b in self.open.values() if b - a > REST}
        self.borders = []
        for low, high in sorted(wide):
            tries = 4 * TRIES
            keys = {low + (high - low) * k // (tries + 1) for k in range(1, tries + 1)} - {low, high}
            self.borders += _value(np.array(sorted(keys), np.uint64)).tolist()


def quantiles(df: DataFrame, features: Sequence[str] | Mapping[str, str], at: Sequence[float], about: Mapping[str, dict] | None = None) -> dict[str, list[float] | None]:
    """Exact linear quantiles of each column's values at the shares; None without values.

    Values below borders near each wanted rank are counted in a scan; the
    borders close in until few values are left between them, which are sorted:
    two or three scans after that of moments(), and at most REST values of a
    column and rank leave their task. Equal values are found as a border.
    """
    columns = as_columns(features)
    about = moments(df, columns) if about is None else about
    places = {f: [p * (about[f]["n"] - 1) for p in at] for f in columns if about[f]["n"]}
    searches = {f: _Search(about[f], {r for p in ps for r in (int(np.floor(p)), int(np.ceil(p)))}) for f, ps in places.items()}
    while some := {f: s.borders for f, s in searches.items() if s.open and s.borders}:
        asked = list(some)
        counts = border_counts(df, {str(k): columns[f] for k, f in enumerate(asked)}, {str(k): some[f] for k, f in enumerate(asked)})
        for r in counts.collect():  # a row for each column
            f = asked[int(r.feature)]
            searches[f].narrow(r.codes[: 2 * len(some[f]) + 1])
    if rest := {f: s for f, s in searches.items() if s.open}:
        spans = {f: sorted({(low, high, a) for low, high, a, _ in s.open.values()}) for f, s in rest.items()}
        names = list(rest)

        def run(first: int, n: int, batches) -> Iterator[pa.RecordBatch]:
            for values, _ in batches:
                feature, span, kept = [], [], []
                for k, v in enumerate(values):
                    key = _key(_present(v))
                    for j, (low, high, _) in enumerate(spans[names[first + k]]):
                        own = key[(key > np.uint64(max(low, 0))) & (key < np.uint64(min(high, (1 << 64) - 1)))] if low >= 0 else key[key < np.uint64(high)]
                        if len(own):
                            feature.append(first + k)
                            span.append(j)
                            kept.append(_value(own))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(span, pa.int32()), pa.array(kept, pa.list_(pa.float64()))], ["feature", "span", "v"])

        left = scan(df, {f: columns[f] for f in names}, run, "feature int, span int, v array<double>")
        ordered = left.groupBy("feature", "span").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))  # at most REST values
        wanted = [(names.index(f), spans[f].index((low, high, a)), r, r - a) for f, s in rest.items() for r, (low, high, a, _) in s.open.items()]
        asked = df.sparkSession.createDataFrame(wanted, "feature int, span int, rank long, place int")
        for r in ordered.join(asked, ["feature", "span"]).select("feature", "rank", F.get("v", F.col("place")).alias("v")).collect():
            searches[names[r.feature]].found[r["rank"]] = r.v
    out: dict[str, list[float] | None] = {f: None for f in columns}
    for f, ps in places.items():
        ends = [(searches[f].found[int(np.floor(p))], searches[f].found[int(np.ceil(p))], p - np.floor(p)) for p in ps]
        out[f] = [float(a if a == b else (1 - t) * a + t * b) for a, b, t in ends]
    return out


def edges_of(found: Mapping[str, list[float] | None]) -> dict[str, list[float] | None]:
    """Distinct quantiles in order, rounded so that the last bits of their making don't part equal ones."""
    return {f: None if q is None else sorted({round(x, 9) + 0.0 for x in q}) for f, q in found.items()}


def inner(edges: Sequence[float] | None) -> list[float]:
    """Edges without the first and last, which open to infinity."""
    return list(edges[1:-1]) if edges else []


def bin_counts(counts: DataFrame, closed: str = "right") -> DataFrame:
    """feature, class, bin, n from border_counts: bins (a, b] or [a, b) numbered from 0, missing values in -1; no row without values."""
    code = F.posexplode(F.concat("codes", F.array("missing"))).alias("code", "n")
    rows = counts.select("feature", "class", F.size("codes").alias("width"), code).filter("n > 0")
    at = F.floor((F.col("code") + (0 if closed == "right" else 1)) / 2)
    cells = rows.select("feature", "class", F.when(F.col("code") == F.col("width"), -1).otherwise(at).cast("long").alias("bin"), "n")
    return cells.groupBy("feature", "class", "bin").agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, features: Sequence[str] | Mapping[str, str], summarize: Callable[[np.ndarray, np.ndarray], dict], schema: str, rows: int, classes: Column | None = None, n_classes: int = 1) -> DataFrame:
    """feature and what summarize(values, counts) says of the distinct values of each column and their counts by class, in parts.

    Each task sends sorted distinct values with counts, packed, one row for a
    column and part; parts are by a hash of the value and hold about a million
    (rows: how many the table has, about). summarize's row is one of a part;
    missing values are not among them. schema: of its row.
    """
    columns = as_columns(features)
    names, parts = list(columns), max(1, -(-rows // GROUP_VALUES))

    def packed(held: list[list[tuple]], first: int) -> Iterator[pa.RecordBatch]:
        feature, part, keys, counts = [], [], [], []
        for k, runs in enumerate(held):
            if not runs:
                continue
            key, n = _summed(runs)
            where = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            for p in np.unique(where).tolist():
                own = where == p
                feature.append(first + k)
                part.append(p)
                keys.append(np.diff(key[own], prepend=np.uint64(0)).tobytes())
                counts.append(n[own].tobytes())
        if feature:
            yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(part, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["feature", "part", "keys", "counts"])

    def run(first: int, n: int, batches) -> Iterator[pa.RecordBatch]:
        held, size, most = [[] for _ in range(n)], 0, SUMMED_BYTES
        for values, keep in batches:
            kind = np.asarray(keep[0], np.float64)
            for k, v in enumerate(values):
                v = np.asarray(v, np.float64)
                used = ~np.isnan(v) & ~np.isnan(kind)
                key, at = np.unique(_key(v[used]), return_inverse=True)
                if not len(key):
                    continue
                counts = np.bincount(at * n_classes + kind[used].astype(np.int64), minlength=len(key) * n_classes).reshape(-1, n_classes)
                held[k].append((key, counts))
                size += 8 * len(key) * (1 + n_classes)
            if size > most:
                for k, runs in enumerate(held):
                    held[k] = [_summed(runs)] if runs else []
                size = sum(8 * len(r[0][0]) * (1 + n_classes) for r in held if r)
                if size > HELD_BYTES / 2:
                    yield from packed(held, first)
                    held, size = [[] for _ in range(n)], 0
                most = max(SUMMED_BYTES, 2 * size)  # values that come again are held about twice, not as often as they come
        yield from packed(held, first)

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        runs = [(np.cumsum(np.frombuffer(k.as_py(), np.uint64), dtype=np.uint64), np.frombuffer(c.as_py(), np.int64).reshape(-1, n_classes)) for k, c in zip(rows["keys"], rows["counts"], strict=True)]
        keys, counts = _summed(runs)
        said = summarize(_value(keys), counts)
        return pa.table({"feature": [names[key[0].as_py()]], **{k: [v] for k, v in said.items()}}).cast(shape)

    one = F.lit(0) if classes is None else classes
    shape = _arrow_schema(df, f"feature string, {schema}")
    found = scan(df, columns, run, "feature int, part long, keys binary, counts binary", one)
    return found.groupBy("feature", "part").applyInArrow(join, f"feature string, {schema}")


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    keys, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))

