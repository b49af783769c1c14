"""Token ids as wavelet matrices: one compressed file a shard, with access, rank, select and the documents' places."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import byte_characters
from .parts import cut, distinct, gather, joined, slices
from .tables import text_bytes

#: Ids in a file at most, and in a row on the way to one; ids that a worker keeps are those of so many parts at most.
SHARD_IDS, ROW_IDS, CACHE_PARTS = 1 << 22, 1 << 18, 300_000
#: Bits of a plane that are compressed together, as a power of two.
CHUNK = 16
#: A space or line end at most, then Latin letters.
_LETTERS = re.compile("[ \n]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_HEAD = struct.Struct("<4sBBQQQ")
_MAGIC = b"PLW1"


def write_file(ids: np.ndarray, planes: int, docs: pa.RecordBatch) -> bytes:
    """A wavelet matrix of the ids, highest bit first, as a file.

    Head, documents (Arrow), directory (for each plane the number of zeros, the
    ones before each chunk and the chunk's place), chunks. All but the head is
    compressed, each chunk on its own, so a lookup reads a chunk a plane.
    """
    if len(ids) and int(ids.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} bits")
    pack = zstandard.ZstdCompressor(level=1)
    rows, size, n = ids.astype(np.uint16 if planes <= 16 else np.uint32), 1 << (CHUNK - 3), len(ids)
    chunks = -(-n >> CHUNK) if n else 0
    directory, data, at = [], [], 0
    for plane in range(planes - 1, -1, -1):
        ones = ((rows >> plane) & 1).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), size), dtype=np.int64) if n else np.empty(0, np.int64)
        places = [at]
        for k in range(chunks):
            raw = bits[k * size : (k + 1) * size].tobytes()
            small = pack.compress(raw)
            data.append(small if len(small) < len(raw) else raw)
            at += len(data[-1])
            places.append(at)
        directory += [np.array([n - int(counts.sum())]), np.concatenate([[0], np.cumsum(counts)]), np.array(places)]
        rows = np.concatenate([rows[~ones], rows[ones]])
    index = pack.compress(np.concatenate(directory).astype("<i8").tobytes())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(docs)
    listed = sink.getvalue().to_pybytes()
    return b"".join([_HEAD.pack(_MAGIC, planes, CHUNK, n, len(listed), len(index)), listed, index, *data])


class WaveletFile:
    """Lookups in a file that write_file made; chunks are unpacked when they are first needed."""

    def __init__(self, data: bytes):
        magic, self.planes, chunk, self.n, listed, index = _HEAD.unpack_from(data)
        if magic != _MAGIC or chunk != CHUNK:
            raise ValueError("not a token file of this version")
        at, self.data = _HEAD.size, memoryview(data)
        self._docs = self.data[at : at + listed]
        unpack, chunks = zstandard.ZstdDecompressor(), -(-self.n >> CHUNK) if self.n else 0
        table = np.frombuffer(unpack.decompress(self.data[at + listed : at + listed + index]), "<i8").reshape(self.planes, 2 * chunks + 3)
        self.zeros, self.ones, self.places = table[:, 0], table[:, 1 : chunks + 2], table[:, chunks + 2 :]
        self.blocks = self.data[at + listed + index :]
        self._unpack, self._chunks = unpack, {}

    def documents(self) -> pa.Table:
        """id, at (ids of the document before this file), n (its ids here), last (whether it ends here), in order."""
        return pa.ipc.open_stream(self._docs).read_all()

    def _raw(self, plane: int, k: int) -> bytes:
        a, b = self.places[plane][k : k + 2]
        raw = self.blocks[a:b]
        size = min(1 << (CHUNK - 3), -(-(self.n - (k << CHUNK)) // 8))
        return bytes(raw) if len(raw) == size else self._unpack.decompress(raw)

    def _bits(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._chunks:
            n = min(1 << CHUNK, self.n - (k << CHUNK))
            self._chunks[plane, k] = np.unpackbits(np.frombuffer(self._raw(plane, k), np.uint8), count=n, bitorder="little")
        return self._chunks[plane, k]

    def _rank(self, plane: int, at: int) -> int:
        """Ones before a place of a plane."""
        k = at >> CHUNK
        return int(self.ones[plane][k]) + (int(self._bits(plane, k)[: at - (k << CHUNK)].sum()) if at < self.n and at & ((1 << CHUNK) - 1) else 0) if at < self.n else int(self.ones[plane][-1])

    def _select(self, plane: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the ones or zeros of a plane with these numbers."""
        before = self.ones[plane] if bit else np.minimum(np.arange(len(self.ones[plane])) << CHUNK, self.n) - self.ones[plane]
        chunk, out = np.searchsorted(before, which, "right") - 1, np.empty(len(which), np.int64)
        for k in np.unique(chunk).tolist():
            mine = chunk == k
            out[mine] = np.flatnonzero(self._bits(plane, k) == bit)[which[mine] - before[k]] + (k << CHUNK)
        return out

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            bit, ones = int(self._bits(plane, at >> CHUNK)[at & ((1 << CHUNK) - 1)]), self._rank(plane, at)
            value = value * 2 + bit
            at = int(self.zeros[plane]) + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id among places start to end stand below the last plane."""
        if token >> self.planes or token < 0:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank(plane, start), self._rank(plane, end)
            start, end = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if token >> (self.planes - 1 - plane) & 1 else (start - a, end - b)
            if start == end:
                break
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs from start up to end (rank)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrences(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Places of an id in rising order; from its first-th on, most of them (select)."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(min(a + first, b), b if most is None else min(b, a + first + most))
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            if len(at):
                at = self._select(plane, bit, at - int(self.zeros[plane]) if bit else at)
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        rows = np.zeros(self.n, kind)
        for plane in range(self.planes - 1, -1, -1):
            bits = b"".join([self._raw(plane, k) for k in range(self.places.shape[1] - 1)])
            ones = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n, bitorder="little").astype(bool)
            above, zeros = np.empty(self.n, kind), int(self.zeros[plane])
            above[~ones] = rows[:zeros]
            above[ones] = rows[zeros:] | kind(1 << (self.planes - 1 - plane))
            rows = above
        return rows


class PartEncoder:
    """Ids of whole texts by a byte-level tokenizer, part by part: as it comes, or (plain) with its special tokens' strings as plain text."""

    def __init__(self, path: str, plain: bool = False, keep: int = CACHE_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens, self.keep = plain, keep
        self.planes = max(1, int(self.model.get_vocab_size() - 1).bit_length())
        self.bpe, self.shown = self.model.model, dict(enumerate(byte_characters()))
        self.line = array("I", self.model.encode("\n", add_special_tokens=False).ids).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def lookup(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct parts, as 32-bit integers."""
        known, older, shown, tokenize, odd = self.known, self.older, self.shown, self.bpe.tokenize, []
        for part in parts:
            if part not in known:
                if (ids := older.get(part)) is not None:
                    known[part] = ids
                elif _LETTERS.fullmatch(text := part.decode()):  # one match of the pattern; only its merges are left to do
                    line = part[0] == 10  # a match of its own
                    known[part] = line * self.line + array("I", [t.id for t in tokenize(part[line:].decode("latin-1").translate(shown))]).tobytes()
                else:
                    odd.append(text)
        for k in range(0, len(odd), 4096):
            for text, made in zip(odd[k : k + 4096], self.model.encode_batch(odd[k : k + 4096], add_special_tokens=False), strict=True):
                known[text.encode()] = array("I", made.ids).tobytes()
        out = [known[p] for p in parts]
        if len(known) > self.keep:  # those that were not met since the last time go
            self.known, self.older = {}, known
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n+1 places where they start."""
        data, offsets = text_bytes(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        borders, first = cut(data, offsets, b" \n\t\r", stems=True)
        parts, which = distinct(data, borders)
        ids, ends = gather(*joined(self.lookup(parts), "<u4"), which)
        return ids, ends[first]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


def _borders(docs: DataFrame, id_col: str, n: int) -> np.ndarray:
    """Ids that deal the rows out evenly, in rising order; one that many rows have comes several times."""
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    return np.array(found or [], np.int64)


def write_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of all texts in rising order of id: bucket, shard, first (ids of the bucket before it), n, file.

    Each text is encoded whole, as the tokenizer comes, and ends with end_id;
    null and empty texts have that alone. Ids are integers; null comes first,
    rows of one id come in order of a hash of their text, repeated rows each for
    themselves. Rows are dealt by ranges of id into buckets; a bucket is cut
    into files of SHARD_IDS ids, a document into several files where need be,
    so no task holds more than a document and a file. Other columns are ignored.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    borders = _borders(docs, id_col, 4 * parts)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, row = encoder(path), TaskContext.get().partitionId() << 36
        small = "<u2" if made.planes <= 16 else "<u4"
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, starts = made.encode(part.column("text"))
                key = part.column("id").cast(pa.int64())
                known = key.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(borders, known, "left"), np.searchsorted(borders, known, "right")
                tie = part.column("tie").to_numpy(zero_copy_only=False)
                share = (tie.astype(np.float64) + 2.0**63) / 2.0**64  # rows of an id that fills buckets go to them by their hash
                bucket = low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)
                out: list[list] = [[], [], [], [], []]
                for k in range(len(part)):
                    mine = np.append(ids[starts[k] : starts[k + 1]], end_id).astype(small)
                    for piece, at in enumerate(range(0, len(mine), ROW_IDS)):
                        for held, x in zip(out, (k, row, piece, len(mine), mine[at : at + ROW_IDS].tobytes()), strict=True):
                            held.append(x)
                    row += 1
                which = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()).take(which), key.take(which), part.column("tie").take(which), *[pa.array(x, kind) for x, kind in zip(out[1:], (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]], ["bucket", "id", "tie", "row", "piece", "size", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = encoder(path).planes
        small = "<u2" if planes <= 16 else "<u4"
        bucket, shard, first, held, n, listed = None, 0, 0, [], 0, []

        def finish() -> pa.RecordBatch:
            docs = pa.RecordBatch.from_pydict({"id": pa.array([x[0] for x in listed], pa.int64()), "at": pa.array([x[1] for x in listed], pa.int64()), "n": pa.array([x[2] for x in listed], pa.int64()), "last": pa.array([x[3] for x in listed], pa.bool_())})
            data = write_file(np.concatenate(held), planes, docs)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["bucket", "shard", "first", "n", "file"])

        doc, at = None, 0
        for batch in batches:
            for of, key, row, size, data in zip(*[batch.column(c).to_pylist() for c in ("bucket", "id", "row", "size")], batch.column("ids"), strict=True):
                if of != bucket:
                    if n:
                        yield finish()
                    bucket, shard, first, held, n, listed = of, 0, 0, [], 0, []
                if row != doc:
                    doc, at = row, 0
                ids = np.frombuffer(data.as_buffer(), small)
                while len(ids):
                    some = ids[: SHARD_IDS - n]
                    held.append(some)
                    if listed and at and listed[-1][4] == row:
                        listed[-1][2] += len(some)
                    else:
                        listed.append([key, at, len(some), False, row])
                    at += len(some)
                    n += len(some)
                    listed[-1][3] = at == size
                    ids = ids[len(some) :]
                    if n == SHARD_IDS:
                        yield finish()
                        shard, first, held, n, listed = shard + 1, first + n, [], 0, []
        if n:
            yield finish()

    sent = rows.mapInArrow(encode, "bucket int, id long, tie long, row long, piece int, size long, ids binary")
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "tie", "row", "piece")
    return dealt.mapInArrow(build, "bucket int, shard int, first long, n long, file binary")


def with_starts(shards: DataFrame) -> DataFrame:
    """shards with start: the ids in all files before each."""
    totals = shards.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket, four for each shuffle partition
    offsets = totals.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return shards.join(F.broadcast(offsets), F.col("bucket") == F.col("of")).select("bucket", "shard", (F.col("first") + F.col("before")).alias("start"), "n", "file")


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of every document, read back from the files (start: ids of all documents before it)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("file"), strict=True):
                file = WaveletFile(data.as_py())
                docs, ids = file.documents(), file.ids().astype("<u4")
                sizes = docs["n"].to_numpy()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                begun = start + ends - sizes - docs["at"].to_numpy()
                whole = docs["last"].to_numpy() & (docs["at"].to_numpy() == 0)
                yield pa.RecordBatch.from_arrays([docs["id"].combine_chunks(), pa.array(begun), docs["at"].combine_chunks(), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(whole)], ["id", "start", "at", "n", "crc", "whole"])

    def join(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, crc = pieces.sort_values("at"), 0
        for n, own in zip(pieces["n"].tolist(), pieces["crc"].tolist(), strict=True):
            gap = bytes(4 * n)
            crc = zlib.crc32(gap, crc) ^ zlib.crc32(gap) ^ own  # of the ids so far, then these: linear in the bits
        out = pieces.iloc[:1][["id", "start"]].copy()
        out["n_tokens"], out["ids_crc32"] = int(pieces["n"].sum()), crc
        return out

    pieces = with_starts(shards).select("start", "file").mapInArrow(read, "id long, start long, at long, n long, crc long, whole boolean")
    whole = pieces.filter("whole").select("id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.filter("not whole").groupBy("start").applyInPandas(join, "id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, count: how often each of the tokens occurs in all files, by ranks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("file"):
                file = WaveletFile(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([file.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """position: the places of a token among all ids of all files, by rank and select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("file"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(WaveletFile(data.as_py()).occurrences(token) + start, pa.int64())], ["position"])

    return with_starts(shards).select("start", "file").mapInArrow(run, "position long")


def tokens_at(shards: DataFrame, places: DataFrame, column: str = "position") -> DataFrame:
    """places with token: the id at each place of all files; null outside. The files with places are each sent once."""
    located = with_starts(shards)
    wanted = places.select(F.col(column).cast("long").alias("place")).filter("place is not null").distinct()
    ranges = located.select("bucket", "shard", "start", "n")
    asked = wanted.join(ranges, (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n"))).groupBy("bucket", "shard").agg(F.collect_list("place").alias("asked"))  # at most a file's ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, asked, data in zip(batch.column("start").to_pylist(), batch.column("asked").to_pylist(), batch.column("file"), strict=True):
                file = WaveletFile(data.as_py())
                found = [file.access(p - start) for p in asked] if len(asked) < 4096 else file.ids()[np.array(asked) - start].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64())], ["place", "token"])

    found = located.join(asked, ["bucket", "shard"]).select("start", "asked", "file").mapInArrow(run, "place long, token long")
    return places.join(found, places[column].cast("long") == F.col("place"), "left").drop("place")
