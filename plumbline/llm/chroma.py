"""Media columns: chroma audio fingerprints, and alignment of recordings by offset histograms and bit errors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.skew import skewed_join

from .tables import text_bytes, texts, written

RATE, FRAME, HOP = 2_000, 256, 64
#: Frames that are transformed at a time, whatever a recording's length.
BLOCK = 2_048
#: Recordings that are made at a time, and bytes of text to be sung or of prints, whichever is reached first.
FEW_ROWS, FEW_BYTES = 128, 1 << 18
LOWEST = 440.0
#: Filters over the chroma image: kind, first pitch class, pitch classes, frames. Kinds: all, halves by pitch, halves by time, quarters, thirds by pitch, thirds by time.
KINDS = 6
WIDTH = 8
FILTERS = tuple((k % KINDS, 5 * k % 12 % (13 - h), h, w) for k in range(16) for h, w in [((2, 4, 6, 3, 8, 12)[k % 6], (4, 8, 6, 8, 4, 6)[k // 3 % 6])])
#: Borders of a filter's four levels, coded so that neighbours differ in one bit.
LEVELS, GRAY = np.array([-0.5, 0.0, 0.5]), np.array([0, 1, 3, 2], np.uint32)
#: A landmark is two integers so many frames apart, so that phrases much shorter than a match propose none.
STEP = 24
#: Parts of the landmarks, by their keys, that are looked up one after the other, so that less lies on disk at a time.
PASSES = 2
#: Pairs of places of one key in two recordings up to which their offsets are counted one by one, not by a transform.
FEW_PAIRS = 1 << 16
#: Hits at one offset that propose it, aligned frames in a row and share of their bits that may differ for a match.
LEAST_HITS, LEAST_FRAMES, MOST_ERROR = 1, 48, 0.15
#: Loudness of the noise in an excerpt, of at most 127.
NOISE = 5


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of the 12 pitch classes in each frame, scaled to length 1; silence is 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    tones = np.arange(1, FRAME // 2 + 1) * RATE / FRAME
    pitch = np.round(12 * np.log2(tones / LOWEST)).astype(int) % 12
    heard = (tones > LOWEST * 2 ** (-0.5 / 12)) & (tones < min(4 * LOWEST, RATE / 2))
    fold = np.zeros((FRAME // 2 + 1, 12))
    fold[1:][heard, pitch[heard]] = 1
    frames, window = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP], np.hanning(FRAME)
    energy = np.empty((len(frames), 12))
    for at in range(0, len(frames), BLOCK):
        energy[at : at + BLOCK] = np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)) ** 2 @ fold
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(size > 1e-6 * FRAME, energy / np.maximum(size, 1e-30), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame with WIDTH frames from it on: 16 filters of two bits."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        return total[at + t + w, y + h] - total[at + t, y + h] - total[at + t + w, y] + total[at + t, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, h)
        if kind == 0:
            rest = area(0, 0, w, 12) - whole
        elif kind == 1:
            rest = area(0, y + h // 2, w, h - h // 2)
        elif kind == 2:
            rest = area(w // 2, y, w - w // 2, h)
        elif kind == 3:
            rest = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
        elif kind == 4:
            rest = area(0, y + h // 3, w, max(h // 3, 1))
        else:
            rest = area(w // 3, y, max(w // 3, 1), h)
        value = np.log1p(np.maximum(whole - rest, 0)) - np.log1p(np.maximum(rest, 0))
        out = out << np.uint32(2) | GRAY[np.searchsorted(LEVELS, value)]
    return out


NOTES = [(100 * np.sin(2 * np.pi * LOWEST * 2 ** (k / 12) * np.arange(2 * HOP) / RATE)).astype(np.int8).tobytes() for k in range(12)]


def sung(text: bytes) -> bytes:
    """A note for each word, its pitch class fixed by a hash of the word, as signed bytes at RATE."""
    return b"".join([NOTES[xxhash.xxh32_intdigest(w) % 12] for w in text.lower().split()])


def excerpt(pcm: bytes) -> bytes:
    """The sound from about a fifth on, not at a frame's border, with noise that its length fixes."""
    clean = np.frombuffer(pcm, np.int8)[len(pcm) // 5 // HOP * HOP + HOP // 8 :]
    noise = np.random.default_rng(len(clean)).integers(-NOISE, NOISE + 1, len(clean))
    return np.clip(clean + noise, -127, 127).astype(np.int8).tobytes()


def _few(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of FEW_ROWS rows, or fewer if the column has FEW_BYTES; a longer value is a slice of its own."""
    for batch in batches:
        sizes, at = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.large_binary())], 0
        while at < batch.num_rows:
            end, size = at, 0
            while end < batch.num_rows and end - at < FEW_ROWS and (end == at or size + sizes[end] <= FEW_BYTES):
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def _kinds(df: DataFrame, ids: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids), more])


def render(docs: DataFrame, ids: list[str], text_col: str) -> DataFrame:
    """ids and pcm: each text sung. Null and empty texts give no samples."""
    rows = docs.select(*ids, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(map(sung, texts(batch.column("__text"))), pa.binary())], [*ids, "pcm"])

    return rows.mapInArrow(run, _kinds(rows, ids, "pcm binary"))


def rendered_fingerprints(docs: DataFrame, ids: list[str], text_col: str, excerpts: bool = False) -> DataFrame:
    """ids and print of each text as render() sings it, or of an excerpt of that; the sound, twenty times the text, stays in the task."""
    rows = docs.select(*ids, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "__text"):
            sounds = (excerpt(sung(t)) if excerpts else sung(t) for t in texts(batch.column("__text")))
            made = [fingerprint(np.frombuffer(b, np.int8)).astype("<u4").tobytes() for b in sounds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(made, pa.binary())], [*ids, "print"])

    return rows.mapInArrow(run, _kinds(rows, ids, "print binary"))


def fingerprints(media: DataFrame, ids: list[str], pcm_col: str = "pcm") -> DataFrame:
    """ids and print (little-endian 32-bit integers, packed) of each recording; null and short ones have none."""
    rows = media.select(*ids, F.col(pcm_col).alias("__pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "__pcm"):
            sounds = (x.as_buffer() if x.is_valid else b"" for x in batch.column("__pcm"))  # not copied
            made = [fingerprint(np.frombuffer(b, np.int8)).astype("<u4").tobytes() for b in sounds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(made, pa.binary())], [*ids, "print"])

    return rows.mapInArrow(run, _kinds(rows, ids, "print binary"))


def landmarks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many places each has, and all places, by key and in order."""
    n = max(len(prints) - STEP, 0)
    mix = lambda key: (key := key * np.uint64(0x9E3779B97F4A7C15)) ^ key >> np.uint64(29)
    keys = mix(mix(prints[:n].astype(np.uint64)) ^ prints[STEP:]).view(np.int64)
    at = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[at], prepend=~keys[at[:1]]) != 0)
    return keys[at[first]], np.diff(np.append(first, n)), at.astype("<i4")


def _posts(groups: DataFrame, part: int | None = None) -> DataFrame:
    """class, key and its places in the class's print, packed, one row for each distinct key; of one of PASSES parts of the keys, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "print"):
            owners, keys, sizes, places = [], [], [], []
            for n, data in zip(batch.column("class").to_pylist(), batch.column("print").to_pylist(), strict=True):
                key, size, at = landmarks(np.frombuffer(data, "<u4"))
                if part is not None:
                    own = (key >> 7) % PASSES == part
                    key, size, at = key[own], size[own], at[np.repeat(own, size)]
                owners.append(np.full(len(key), n, np.int64))
                keys.append(key)
                sizes.append(size)
                places.append(at)
            ends = np.concatenate([[0], np.cumsum(4 * np.concatenate(sizes))]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(places).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys)), packed], ["class", "key", "at"])

    return groups.select("class", "print").mapInArrow(run, "class long, key long, at binary")


def offsets(places: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each difference of a place (in order) and an asked one (in order), and how many pairs have it."""
    if len(places) * len(asked) <= FEW_PAIRS:
        return np.unique(np.subtract.outer(places, asked), return_counts=True)
    low, wide = int(places[0]) - int(asked[-1]), int(places[-1] - places[0] + asked[-1] - asked[0]) + 1
    size = 1 << wide.bit_length()
    product = np.fft.rfft(np.bincount(places - places[0], minlength=size)) * np.fft.rfft(np.bincount(asked[-1] - asked, minlength=size))
    counts = np.rint(np.fft.irfft(product, size)[:wide]).astype(np.int64)
    found = np.flatnonzero(counts)
    return found + low, counts[found]


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The offsets of each key that a query and a class have, with how many pairs of its places have them."""
    for batch in (b.slice(at, FEW_ROWS << 5) for b in batches for at in range(0, b.num_rows, FEW_ROWS << 5)):
        sides = []
        for c in ("at", "q_at"):
            data, ends = text_bytes(batch.column(c))
            sides.append((data.view("<i4") if len(data) else np.empty(0, "<i4"), ends // 4))
        (at, ends), (q_at, q_ends) = sides
        queries, classes = (batch.column(c).to_numpy() for c in ("query", "class"))
        one = (np.diff(ends) == 1) & (np.diff(q_ends) == 1)
        yield _offset_rows(queries[one], classes[one], at[ends[:-1][one]] - q_at[q_ends[:-1][one]], np.ones(one.sum(), np.int64))
        for k in np.flatnonzero(~one).tolist():
            found, counts = offsets(at[ends[k] : ends[k + 1]], q_at[q_ends[k] : q_ends[k + 1]])
            yield _offset_rows(np.full(len(found), queries[k]), np.full(len(found), classes[k]), found, counts)


def _offset_rows(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype(), copy=False)) for c, k in zip(columns, kinds, strict=True)], ["query", "class", "offset", "hits"])


def stretch(one: np.ndarray, two: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(start in one, frames, differing bits) of the stretch that is alike the longest: of all, the one where MOST_ERROR would allow the most bits more than differ."""
    lo, hi = max(0, -offset), min(len(one), len(two) - offset)
    if hi <= lo:
        return 0, 0, 0
    wrong = np.concatenate([[0], np.cumsum(np.bitwise_count(one[lo:hi] ^ two[lo + offset : hi + offset]), dtype=np.int64)])
    spare = MOST_ERROR * 32 * np.arange(len(wrong)) - wrong
    least = np.minimum.accumulate(spare)
    end = int(np.argmax(spare - least))
    start = int(np.argmax(spare[: end + 1] == least[end]))
    return lo + start, end - start, int(wrong[end] - wrong[start])


def matches(one: np.ndarray, two: np.ndarray, offsets: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(offset, hits, start, frames, bit error) of matches: of offsets closer than WIDTH the one with the most frames alike, then the fewest errors, the least offset.

    Offsets are compared from the largest overlap on, which bounds the frames
    alike, so that those close to a chosen one need not be compared.
    """
    overlap = np.minimum(len(one), len(two) - offsets) - np.maximum(0, -offsets)
    order = np.lexsort((offsets, -overlap))
    order = order[overlap[order] >= LEAST_FRAMES].tolist()
    held: list[tuple] = []
    chosen: dict[int, int] = {}
    out, at = [], 0

    def close(offset: int) -> bool:
        return any(abs(chosen.get(offset // WIDTH + d, offset + WIDTH) - offset) < WIDTH for d in (-1, 0, 1))

    while at < len(order) or held:
        while at < len(order) and (not held or overlap[order[at]] >= -held[0][0]):
            offset = int(offsets[order[at]])
            if not close(offset):
                start, n, wrong = stretch(one, two, offset)
                if n >= LEAST_FRAMES:
                    heapq.heappush(held, (-n, wrong, offset, int(hits[order[at]]), start))
            at += 1
        if held:
            n, wrong, offset, hit, start = heapq.heappop(held)
            if not close(offset):
                chosen[offset // WIDTH] = offset  # no other one lies so close
                out.append((offset, hit, start, -n, wrong / (-32 * n)))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each pair at the offsets that had hits, by their bits."""
    for batch in (b.slice(at, FEW_ROWS) for b in batches for at in range(0, b.num_rows, FEW_ROWS)):
        votes, rows = batch.column("votes"), []
        for k in range(batch.num_rows):
            own = votes[k].values
            one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in ("one", "two"))
            rows += [(k, *m) for m in matches(one, two, *(own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("offset", "hits")))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        own = batch.select(["query", "class"]).take(pa.array(columns[0], pa.int64()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([own.column("query"), own.column("class"), *(pa.array(v, t) for v, t in zip(columns[1:], kinds, strict=True))], ["query", "class", *FOUND])


FOUND = ["offset", "hits", "start", "frames", "bit_error"]


def _classes(prints: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, digest of each recording with a print; class, id, digest, print, members of each distinct print), by a 256-bit digest of the print. A class is a number; its id is the smallest."""
    rows = written(prints.filter(F.length("print") > 0).select(F.struct(*ids).alias("id"), F.unhex(F.sha2("print", 256)).alias("digest"), "print"), "prints")
    groups = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.min("print").alias("print"))
    return rows.select("id", "digest"), written(groups.withColumn("class", F.monotonically_increasing_id()), "classes")


def _met(groups: DataFrame, asked_groups: DataFrame) -> DataFrame:
    """query, class, offset, hits of each key that both have. Of the searched posts only those move on that share a key with a query; those of a key that many have are dealt over several tasks."""
    asked, near = written(_posts(asked_groups), "asked"), None
    for part in range(PASSES):
        some = written(_posts(groups, part).join(asked.select("key").distinct(), "key", "left_semi"), "near")
        near = some if near is None else near.unionAll(some)
    hits = skewed_join(near, asked.select("key", F.col("at").alias("q_at"), F.col("class").alias("query")), ["key"])
    return hits.select("query", "class", "at", "q_at").mapInArrow(_hits, "query long, class long, offset int, hits long")


def align(prints: DataFrame, queries: DataFrame, ids: list[str]) -> DataFrame:
    """Recordings that share a stretch of sound with each query.

    prints and queries: ids and print. Equal prints are one class, named by its
    smallest ids, and are compared once. Classes meet at equal landmarks, at
    every place of each and however many have them, so what a recording matches does not depend on how
    many others there are; the pairs of a passage that n recordings and q
    queries share are q times n, as is the result. The histogram of offsets
    keeps each offset with LEAST_HITS; there the bits of the whole overlap are
    compared, and the longest stretch of at most MOST_ERROR wrong bits is a
    match if it has LEAST_FRAMES. Offsets closer than WIDTH are one match.

    Null ids sort first; recordings without a print have no rows, and no
    stretch of fewer than LEAST_FRAMES frames matches, whole recordings
    included. Rows with equal ids are each answered. Returns ids of the query,
    match (a struct of ids: the class), members, offset (frames by which the
    match is later), hits, start (frame of the query), frames, bit_error.
    """
    _, groups = _classes(prints, ids)
    asked, asked_groups = _classes(queries, ids)
    met = _met(groups, asked_groups)
    votes = met.groupBy("query", "class", "offset").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= LEAST_HITS)
    pairs = votes.groupBy("query", "class").agg(F.collect_list(F.struct("offset", "hits")).alias("votes"))
    one, two = asked_groups.select(F.col("class").alias("query"), F.col("print").alias("one")), groups.select("class", F.col("print").alias("two"))
    pairs = pairs.join(one, "query").join(two, "class")
    found = pairs.mapInArrow(_compare, _kinds(pairs, ["query", "class"], "offset int, hits long, start int, frames int, bit_error double"))
    named = asked.join(asked_groups.select("digest", F.col("class").alias("query")), "digest").select("id", "query")
    told = found.join(groups.select("class", F.col("id").alias("match"), "members"), "class")
    return named.join(told, "query").select("id.*", "match", "members", *FOUND)
