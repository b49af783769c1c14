"""SimHash near-dedup with vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import texts, written

#: Three parts of the 64 bits: of at most 4 differing bits, some part has at most one.
PARTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS, PART_RADIUS = 4, 1
#: Fingerprints from which the driver lays out the shards, at most, and one of so many at most; they only set where shards are cut.
SAMPLE, SAMPLE_OF = 400_000, 16
SHARD_POINTS = 8_192
LEAF_POINTS = 192

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], 42) for i, j in zip(starts, ends[words - 1 :], strict=False)], "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (64 bits as a long) of every whole text; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def part_of(fps: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return ((fps >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)).astype(np.uint32)


def split(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point and the ball around it that leave the least work in both branches; None if no ball helps.

    Points at most mu + radius away go in, points more than mu away stay out.
    By the triangle inequality, two points within radius share a branch.
    """
    n, best = len(points), None
    for k in (0, n // 3, n // 2, 2 * n // 3):
        vantage = int(points[k])
        upto = np.cumsum(np.bincount(np.bitwise_count(points ^ np.uint32(vantage)), minlength=33)).astype(np.float64)
        inside, outside = upto[np.minimum(np.arange(32) + radius, 32)], n - upto[:32]
        cost = inside**2 + outside**2
        mu = int(np.argmin(cost))
        if best is None or cost[mu] < best[0]:
            best = (cost[mu], vantage, mu)
    return None if best[0] > 0.92 * float(n) ** 2 else best[1:]


def branches(points: np.ndarray, vantage: int, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(points ^ np.uint32(vantage))
    return np.flatnonzero(d <= mu + radius), np.flatnonzero(d > mu)


def grow(sample: np.ndarray, radius: int, least: int) -> tuple | int:
    """A tree (vantage, mu, inside, outside); 0 for a leaf."""
    if len(sample) <= least or (cut := split(sample, radius)) is None:
        return 0
    inside, outside = branches(sample, *cut, radius)
    return (*cut, grow(sample[inside], radius, least), grow(sample[outside], radius, least))


def route(tree: tuple | int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, the points that belong there); boundary points belong to several leaves."""
    stack, leaf = [(tree, np.arange(len(points)))], 0
    while stack:
        node, rows = stack.pop()
        if node == 0:
            yield leaf, rows
            leaf += 1
            continue
        inside, outside = branches(points[rows], node[0], node[1], radius)
        stack += [(node[3], rows[outside]), (node[2], rows[inside])]


def _near(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all points within MOST_BITS, at most one fewer than the points of a cluster.

    A point takes its neighbours from those not yet reached, so that a dense
    cluster costs one comparison for each point and not one for each pair.
    """
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[k]) <= MOST_BITS
            if close.any():
                found = left[close]
                links += [(k, j) for j in found.tolist()]
                queue += found.tolist()
                left = left[~close]
    return links


def _leaf_links(fps: np.ndarray) -> list[tuple[int, int]]:
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MOST_BITS, 1))
    return list(zip(i.tolist(), j.tolist(), strict=True)) if len(i) <= 2 * len(fps) else _near(fps)


def shard_links(fps: np.ndarray, part: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning links of all pairs that are within MOST_BITS and within PART_RADIUS in the part, by a tree over the shard."""
    points = part_of(fps, part)
    stack, links = [np.arange(len(fps))], []
    while stack:
        rows = stack.pop()
        if len(rows) < 2:
            continue
        cut = split(points[rows], PART_RADIUS) if len(rows) > LEAF_POINTS else None
        if cut:
            inside, outside = branches(points[rows], *cut, PART_RADIUS)
            stack += [rows[inside], rows[outside]]
        else:
            own = _leaf_links(fps[rows]) if len(rows) <= 4 * LEAF_POINTS else _near(fps[rows])
            links += [(int(rows[i]), int(rows[j])) for i, j in own]
    parent: dict[int, int] = {}

    def top(k: int) -> int:
        while (p := parent.get(k, k)) != k:
            parent[k] = parent.get(p, p)
            k = p
        return k

    for i, j in links:
        if (i := top(i)) != (j := top(j)):
            parent[max(i, j)] = min(i, j)
    return [(top(k), k) for k in list(parent) if top(k) != k]


def near_links(points: DataFrame) -> DataFrame:
    """a, b: links that connect exactly the fingerprints within MOST_BITS of each other. points: node, fp (distinct)."""
    spark = points.sparkSession
    total = points.count()
    one_of = max(SAMPLE_OF, total // SAMPLE)
    sample = points.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(one_of)) == 0).orderBy("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    least = max(8, int(SHARD_POINTS * len(sample) / max(total, 1)))
    trees = [grow(part_of(sample, part), PART_RADIUS, least) for part in PARTS]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for t, (tree, part) in enumerate(zip(trees, PARTS, strict=True)):
                for leaf, rows in route(tree, part_of(fps, part), PART_RADIUS):
                    if len(rows):
                        shard = pa.array(np.full(len(rows), leaf * len(PARTS) + t), pa.int64())
                        picked = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([shard, picked.column("node"), picked.column("fp")], ["shard", "node", "fp"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].to_numpy()
        found = shard_links(rows["fp"].to_numpy().view(np.uint64), PARTS[int(rows["shard"].iloc[0]) % len(PARTS)])
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    dealt = points.select("node", "fp").mapInArrow(deal, "shard long, node long, fp long")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked, one row for each document.

    A-Z are lower-cased; words are runs without ASCII white space; the
    fingerprint is over the XXH64 (seed 42) of all 4-word shingles, repeats
    included (fewer words: the whole sequence). Fingerprints link at 4 or fewer
    differing bits. Each of three trees partitions the distinct fingerprints by
    Hamming distance within a third of the bits; points near a ball's boundary
    go to both sides, so every linked pair meets in some shard.

    Null and empty texts have fingerprint 0 and link like others. id_col is an
    integer; a null id gets component_id from its group's other documents.
    Repeated rows give repeated results; other columns are ignored.

    Returns id_col, fingerprint (16 hex digits), component_id (smallest id
    reachable).
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    by_print = prints.groupBy("fp").agg(F.min("id").alias("least"))
    # A fingerprint's node is its smallest id; one without ids gets no node of its own and no component_id.
    points = written(by_print.filter("least is not null").select(F.col("least").alias("node"), "fp"), "points")
    reached = components(near_links(points))
    labels = points.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(labels, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest id. Rows of groups without any id stay."""
    groups = simhash_dedup(docs, id_col, text_col)
    gone = groups.filter(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")
