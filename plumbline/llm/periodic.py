"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import slices
from .tables import texts

#: Segments of more words are scanned by grams of eight words for periods from eight on.
LONG = 2048
SPACE = r"[ \t\n\x0B\f\r]+"


def split_by_frequency(codes: np.ndarray, owner: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """Stretches of words, each within one owner, in which every word occurs as often as it does in a run.

    Every word of a run occurs at least `repeats` times in it. So words that are
    rarer in their segment end segments; the rest is split at them and counted
    anew, until nothing changes or a segment is shorter than a run.
    """
    at, segment, codes = np.arange(len(codes)), owner.astype(np.int64), codes.astype(np.int64)
    stable: list[tuple[int, int]] = []
    while len(at):
        _, which, counts = np.unique(segment << 32 | codes[at], return_inverse=True, return_counts=True)
        rare = counts[which] < repeats
        starts = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1))
        ends = np.append(starts[1:], len(at))
        split = np.logical_or.reduceat(rare, starts)
        stable += [(a, b) for a, b in zip(at[starts[~split]].tolist(), (at[ends[~split] - 1] + 1).tolist(), strict=True) if b - a >= least]
        again = np.repeat(split, ends - starts) & ~rare
        at, segment = at[again], segment[again]
        if not len(at):
            break
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
        segment = np.cumsum(fresh)
        sizes = np.bincount(segment)
        keep = sizes[segment] >= least
        at, segment = at[keep], segment[keep]
    return stable


def _grams(x: np.ndarray) -> np.ndarray:
    """A number for each eight words in a row, equal where they are."""
    for step in (1, 2, 4):
        _, x = np.unique(x[:-step].astype(np.int64) << 32 | x[step:], return_inverse=True)
    return x


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of each stretch of trues that is long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def lag_scan(x: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """start, length, period of every run in one segment.

    A run of period q has at least (repeats - 1) * q pairs of equal words q
    apart, so of every q-th word some in a row have such a pair: only those are
    compared for each lag, and stretches grow around them. Of lags that are
    multiples of a known run's period, its inside is left out: any other run
    shares less than the sum of both periods with it.
    """
    n, found, seen, inside = len(x), [], set(), []
    grams = _grams(x) if n > LONG else None
    for q in range(1, n // repeats + 1):
        y, row = (grams[::q], repeats - 2) if grams is not None and q >= 8 else (x[::q], repeats - 1)
        same = y[1:] == y[:-1]
        inside = [r for r in inside if r[1] - r[0] >= repeats * q]
        for a, b, period in inside:
            if q % period == 0:
                same[-(-a // q) + 1 : max((b - 1 - q) // q, 0)] = False
        some = same[row - 1 :].copy()
        for k in range(row - 1):
            some &= same[k : len(same) - row + 1 + k]
        if not some.any():
            continue
        need = max(least, repeats * q) - q
        for a, b in _stretches(same, row):
            low, high = max(0, (a - 1) * q), min(n - q, b * q + 8)
            for s, e in _stretches(x[low:high] == x[low + q : high + q], need):
                run = (low + s, e - s + q)
                known = s == 0 and low > 0 or low + e == high < n - q  # it goes on where lags were left out
                if not known and run not in seen:
                    seen.add(run)
                    found.append((*run, q))
                    inside.append((run[0], run[0] + run[1], q))
    return found


def runs_of(codes: np.ndarray, owner: np.ndarray, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """start, length, period of all runs in numbered words, by start, then period; no run crosses owners."""
    runs = []
    for a, b in split_by_frequency(codes, owner, least, repeats):
        runs += [(a + start, length, period) for start, length, period in lag_scan(np.unique(codes[a:b], return_inverse=True)[1], least, repeats)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, repeats: int = 4) -> DataFrame:
    """id_col, runs (start, length, period by start, then period) and collapsed (the words left, joined by a space) of every whole text.

    Words are what ASCII white space separates, numbered from 0. A run is a
    stretch with a smallest period q, of at least `least` words and `repeats`
    times q (3 or more), that no neighbouring word extends; of each run all but
    the first q words are left out. Null and empty texts have no runs and
    collapse to an empty one. A row for each row, repeats included; other
    columns are ignored; nothing is shuffled. A text of n words takes about
    n log n steps, and a task holds one text, or some of 8 MB together.
    """
    if repeats < 3:
        raise ValueError("runs repeat three times or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                split = [t.split() for t in texts(part.column("text"))]
                sizes = np.array([len(w) for w in split])
                ends = np.cumsum(sizes)
                words = pa.array([w for ws in split for w in ws], pa.large_binary()).dictionary_encode()
                found: list[list] = [[] for _ in split]
                for start, length, period in runs_of(words.indices.to_numpy(), np.repeat(np.arange(len(split)), sizes), least, repeats):
                    k = int(np.searchsorted(ends, start, "right"))
                    found[k].append({"start": start - int(ends[k] - sizes[k]), "length": length, "period": period})
                left = []
                for ws, runs in zip(split, found, strict=True):
                    if runs:
                        keep = np.ones(len(ws), bool)
                        for r in runs:
                            keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                        ws = [ws[k] for k in np.flatnonzero(keep).tolist()]
                    left.append(b" ".join(ws).decode())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, spans), pa.array(left, pa.string())], ["id", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_run(text: Column, key: Column) -> Column:
    """The text; where key divides by ten, with its words from one on replaced by a stretch of them, again and again."""
    g = F.floor(key / 10)

    def plant(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, plant(w)))[0]  # the words are made once
    return F.when(key % 10 == 0, F.coalesce(planted, text)).otherwise(text)
