"""Two tokenizers' tokens aligned by bytes; linked ids counted over the corpus in sorted runs that are merged outside memory."""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .parts import cut, distinct, gather, joined, slices
from .tables import discard, texts, written
from .wavelet import PartEncoder

#: Parts of text in a block, and distinct ones, after which the next block begins.
BLOCK_PARTS, BLOCK_DISTINCT = 1_500_000, 150_000
#: Runs of each block, by the remainder of B's id; runs merged by one task; pairs in a compressed chunk.
RADIX, FAN, CHUNK_PAIRS = 64, 256, 1 << 16
#: Aligned parts that a worker keeps at most, twice; parts aligned at once; bytes of text looked through at once.
CACHE_PARTS, ALIGNED, TEXT_BYTES = 120_000, 10_000, 2 << 20
_SIZE = struct.Struct("<II")


class Aligner:
    """Aligns parts of texts: ids of a byte-level tokenizer (A) and of a sentencepiece model (B), and which overlap."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = PartEncoder(path_a, plain=True, keep=CACHE_PARTS // 2), SentencePieceProcessor(model_file=path_b)
        byte = {c: k for k, c in enumerate(byte_characters())}
        self.bytes_a = {k: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, k in self.a.model.get_vocab().items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = dict(enumerate(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces))
        sized = lambda held: np.array([len(held.get(k, b"")) for k in range(max(held) + 1)], np.int64)
        self.size_a, self.size_b = sized(self.bytes_a), sized(self.bytes_b)
        self.space = self.b.piece_to_id("▁")
        whole = any("▁" in p.lstrip("▁") for p in pieces)  # a piece over a word's end: texts are not cut
        self.marks = b"" if whole else b" " if any("\n" in p for p in pieces) else b" \n"
        self.known: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}

    def _ids_b(self, parts: list[bytes]) -> list[list[int]]:
        """B's ids; the model adds the space with which a part begins, or one that a part after a line end hasn't."""
        made = self.b.encode([(p[1:] if p[:1] == b" " else p).decode() for p in parts], num_threads=1)
        return [[self.space] if p == b" " else ids if p[:1] == b" " else ids[1:] for p, ids in zip(parts, made, strict=True)]

    def align(self, parts: list[bytes]) -> list[tuple | None]:
        """Of each part: tokens of A and B, groups, their text, links (B's id in the high half); None if its tokens' bytes aren't its own.

        Every stretch between neighbouring ends, of A's or B's tokens, is what
        one token of A and one of B share: a link. Ends of both end groups.
        """
        ids_a, first_a = self.a.encode(pa.array(parts, pa.large_binary()).cast(pa.large_string()))
        ids_b, first_b = joined([np.array(x, "<u4") for x in self._ids_b(parts)], "<u4")
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        good = [b"".join([self.bytes_a[i] for i in list_a[first_a[k] : first_a[k + 1]]]) == p == b"".join([self.bytes_b[i] for i in list_b[first_b[k] : first_b[k + 1]]]) for k, p in enumerate(parts)]
        kept = np.flatnonzero(good)
        ids_a, first_a = gather(ids_a, first_a, kept)
        ids_b, first_b = gather(ids_b, first_b, kept)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        part_ends = np.cumsum([len(parts[k]) for k in kept], dtype=np.int64)
        ends, both = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = ids_b[np.searchsorted(ends_b, ends)].astype(np.int64) << 32 | ids_a[np.searchsorted(ends_a, ends)].astype(np.int64)
        link_at, group_at = np.searchsorted(ends, part_ends, "right").tolist(), np.searchsorted(both, part_ends, "right").tolist()
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, x, y = [], 0, 0
        for p, q in zip((np.searchsorted(ends_a, both) + 1).tolist(), (np.searchsorted(ends_b, both) + 1).tolist(), strict=True):
            groups.append(",".join(text_a[x:p]) + "|" + ",".join(text_b[y:q]))
            x, y = p, q
        out: list[tuple | None] = [None] * len(parts)
        link = group = 0
        for j, k in enumerate(kept.tolist()):
            out[k] = (int(first_a[j + 1] - first_a[j]), int(first_b[j + 1] - first_b[j]), group_at[j] - group, ";".join(groups[group : group_at[j]]).encode(), links[link : link_at[j]].tobytes())
            link, group = link_at[j], group_at[j]
        return out

    def lookup(self, parts: list[bytes]) -> list[tuple | None]:
        known, older = self.known, self.older
        new = []
        for part in parts:
            if part not in known:
                if part in older:
                    known[part] = older[part]
                else:
                    new.append(part)
        for k in range(0, len(new), ALIGNED):
            known.update(zip(new[k : k + ALIGNED], self.align(new[k : k + ALIGNED]), strict=True))
        out = [known[p] for p in parts]
        if len(known) > CACHE_PARTS:
            self.known, self.older = {}, known
        return out


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed."""
    data = zstandard.ZstdCompressor(level=1).compress(b"".join([np.ascontiguousarray(a).tobytes() for a in arrays]))
    return data


def _unpacked(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def write_run(chunks: Iterable[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A run of sorted pairs with their counts: compressed chunks, each with its size."""
    out = []
    for keys, counts in chunks:
        for k in range(0, len(keys), CHUNK_PAIRS):
            some = keys[k : k + CHUNK_PAIRS]
            data = _packed(np.diff(some >> 32, prepend=0).astype("<u4"), (some & 0xFFFFFFFF).astype("<u4"), counts[k : k + CHUNK_PAIRS].astype("<i8"))
            out += [_SIZE.pack(len(some), len(data)), data]
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs and counts of each chunk in order, and whether another comes."""
    view, at = memoryview(run), 0
    while at < len(view):
        n, size = _SIZE.unpack_from(view, at)
        at += _SIZE.size
        b, a, counts = _unpacked(bytes(view[at : at + size]), ("<u4", n), ("<u4", n), ("<i8", n))
        at += size
        yield np.cumsum(b.astype(np.int64)) << 32 | a.astype(np.int64), counts, at < len(view)


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the runs in order, counts added up, some at a time.

    A heap holds the last pair of each run's open chunk: up to the smallest,
    nothing can come after what is open. A run's last chunk sets no bound. So
    a chunk a run is open at once.
    """
    readers = [read_run(r) for r in runs]
    opened: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(runs)
    heap: list[tuple[int, int]] = []

    def advance(k: int) -> None:
        chunk = next(readers[k], None)
        opened[k] = chunk[:2] if chunk else None
        if chunk and chunk[2]:
            heapq.heappush(heap, (int(chunk[0][-1]), k))

    for k in range(len(runs)):
        advance(k)
    while any(x is not None for x in opened):
        bound = heap[0][0] if heap else None
        taken, done = [], []
        for k, chunk in enumerate(opened):
            if chunk is None:
                continue
            end = len(chunk[0]) if bound is None else int(np.searchsorted(chunk[0], bound, "right"))
            taken.append((chunk[0][:end], chunk[1][:end]))
            opened[k] = (chunk[0][end:], chunk[1][end:])
            if end == len(chunk[0]):
                done.append(k)
        while heap and bound is not None and heap[0][0] <= bound:
            heapq.heappop(heap)
        for k in done:
            advance(k)
        keys, counts = (np.concatenate([x[j] for x in taken]) for j in (0, 1))
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            yield keys[starts], np.add.reduceat(counts, starts)


def _answer(keys: np.ndarray, counts: np.ndarray, best: np.ndarray, run: bytes, with_keys: bool) -> bytes:
    """Corpus-wide counts, and whether they are their B id's highest, of the pairs of a run in its order."""
    own = [k for k, _, _ in read_run(run)]
    own = np.concatenate(own) if own else np.empty(0, np.int64)
    at = np.searchsorted(keys, own)
    return struct.pack("<Q", len(own)) + _packed(own if with_keys else own[:0], counts[at].astype("<i8"), best[at].astype("u1"))


def _answered(data: bytes, with_keys: bool) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    return _unpacked(data[8:], ("<i8", n if with_keys else 0), ("<i8", n), ("u1", n))


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """block, radix, first, docs, run: a row for each block of documents, and one for each of its runs of pairs.

    The pairs of a block are numbered by radix (B's id modulo RADIX), B, A; a
    run is those of one radix, from first on. docs: the documents' figures,
    their parts in order, and the pairs of each distinct part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 24
        listed: list[pa.RecordBatch] = []
        sequences: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        links: list[bytes] = []
        n = 0

        def finish() -> Iterator[pa.RecordBatch]:
            flat, starts = joined(links, "<i8")
            words = np.concatenate(sequences).astype(np.int64) if sequences else np.empty(0, np.int64)
            keys, pair = np.unique(flat, return_inverse=True)
            counts = np.bincount(pair, np.repeat(np.bincount(words, minlength=len(links)), np.diff(starts)), len(keys)).astype(np.int64)
            order = np.lexsort((keys, (keys >> 32) % RADIX))
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            keys, counts = keys[order], counts[order]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, listed[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for some in listed:
                    writer.write_batch(some)
            table = sink.getvalue().to_pybytes()
            body = _packed(words.astype("<u4"), np.diff(starts).astype("<u4"), place[pair].astype("<u4"))
            held = struct.pack("<QQQQ", len(table), len(words), len(links), len(pair)) + table + body
            borders = np.searchsorted((keys >> 32) % RADIX, np.arange(RADIX + 1))
            radix = [r for r in range(RADIX) if borders[r] < borders[r + 1]]
            runs = [write_run([(keys[borders[r] : borders[r + 1]], counts[borders[r] : borders[r + 1]])]) for r in radix]
            yield pa.RecordBatch.from_arrays([pa.array([block] * (1 + len(radix)), pa.int64()), pa.array([-1, *radix], pa.int32()), pa.array([0, *borders[radix].tolist()], pa.int64()), pa.array([held] + [None] * len(radix), pa.binary()), pa.array([None, *runs], pa.binary())], ["block", "radix", "first", "docs", "run"])

        for batch in batches:
            for a, b in slices(batch.column("text"), TEXT_BYTES):
                part = batch.slice(a, b - a)
                own = texts(part.column("text"))
                data = b"".join([b" " + t for t in own if t])
                offsets = np.cumsum([0, *[len(t) + 1 if t else 0 for t in own]])
                borders, first = cut(np.frombuffer(data, np.uint8), np.unique(offsets), made.marks)
                first = first[np.searchsorted(np.unique(offsets), offsets)]
                some, which = distinct(np.frombuffer(data, np.uint8), borders)
                found = made.lookup(some)
                total = lambda values: (s := np.concatenate([[0], np.cumsum(np.array(values, np.int64)[which] if len(which) else [])]).astype(np.int64))[first[1:]] - s[first[:-1]]
                bad = total([x is None for x in found]) > 0
                sums = [np.where(bad, 0, total([x[j] if x else 0 for x in found])) for j in (0, 1, 2)]
                sums.append(np.where(bad, 0, total([len(x[4]) // 8 if x else 0 for x in found])))
                shown, order = [x[3] if x else b"" for x in found], which.tolist()
                sha = ["" if wrong or p == q else hashlib.sha256(b";".join([shown[i] for i in order[p:q]])).hexdigest() for wrong, p, q in zip(bad.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
                number = np.array([numbers.setdefault(p, len(numbers)) for p in some], np.int64)
                if len(numbers) > len(links):
                    links += [x[4] if x else b"" for p, x in zip(some, found, strict=True) if numbers[p] >= len(links)]
                keep = np.repeat(~bad, np.diff(first))
                sequences.append((number[which][keep] if len(which) else which).astype(np.uint32))
                listed.append(pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(x, pa.int64()) for x in sums], pa.array(sha, pa.string()), pa.array(np.where(bad, 0, np.diff(first)), pa.int64())], ["id", "n_a", "n_b", "n_groups", "n_links", "sha", "parts"]))
                n += len(which)
                if n >= BLOCK_PARTS or len(numbers) >= BLOCK_DISTINCT:
                    yield from finish()
                    block, n, listed, sequences, numbers, links = block + 1, 0, [], [], {}, []
        if listed:
            yield from finish()

    return docs.mapInArrow(run, "block long, radix int, first long, docs binary, run binary")


def _merge_up(key: tuple, rows: pa.Table) -> pa.Table:
    run = write_run(merge_runs([r.as_py() for r in rows["run"]]))
    return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "radix": pa.array([key[1].as_py()], pa.int32()), "first": pa.array([0], pa.int64()), "run": pa.array([run], pa.binary())})


def _give(rows: pa.Table, keys: np.ndarray, counts: np.ndarray, best: np.ndarray, with_keys: bool) -> pa.Table:
    made = [_answer(keys, counts, best, r.as_py(), with_keys) for r in rows["run"]]
    return pa.table({"node": rows["node"], "radix": rows["radix"], "first": rows["first"], "answer": pa.array(made, pa.binary())})


_ANSWERS = "node long, radix int, first long, answer binary"


def count_pairs(runs: DataFrame, nodes: int, fan: int = FAN) -> DataFrame:
    """node, radix, first, answer: for each run (node, radix, first, run) its pairs' counts over all runs, and which are their B id's highest.

    Runs of one radix are merged, at most some `fan` by one task, into longer
    ones until one task has the rest; there all pairs of a B id stand in a row,
    which gives the highest count. Answers go back the same way, each to the
    run that asked. A pair is one record a run, however often it occurs.
    """
    levels, made = [runs], []
    while nodes > fan:
        nodes = -(-nodes // fan)
        levels[-1] = levels[-1].withColumn("parent", F.pmod(F.xxhash64("node", F.lit(len(levels))), F.lit(nodes)))
        merged = levels[-1].groupBy("parent", "radix").applyInArrow(_merge_up, "node long, radix int, first long, run binary")
        levels.append(written(merged, "pair-runs"))
        made.append(levels[-1])

    def top(with_keys: bool):
        def count(rows: pa.Table) -> pa.Table:
            chunks = list(merge_runs([r.as_py() for r in rows["run"]]))
            keys, counts = np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])
            starts = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
            highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))
            return _give(rows, keys, counts, counts == highest, with_keys)

        return count

    def down(with_keys: bool):
        def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, counts, best = _answered(right["answer"][0].as_py(), True)
            return _give(left, keys, counts, best, with_keys)

        return pass_on

    answers = levels[-1].select("node", "radix", "first", "run").groupBy("radix").applyInArrow(top(len(levels) > 1), _ANSWERS)
    for k in range(len(levels) - 2, -1, -1):
        asked = levels[k].select("node", "radix", "first", "run", "parent")
        given = answers.withColumnRenamed("node", "parent")
        answers = asked.groupBy("parent", "radix").cogroup(given.groupBy("parent", "radix")).applyInArrow(down(k > 0), _ANSWERS)
    if made:
        answers = written(answers, "pair-answers")
        discard(*made)
    return answers


def cross_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligns two tokenizers' tokens of every whole text, and says how common its linked ids are in all of them.

    path_a: a byte-level BPE of the tokenizers library, which gets a space and
    the text; path_b: a sentencepiece model, which adds the space. Returns
    id_col, n_a, n_b (tokens), n_groups (stretches between ends of both),
    n_links (pairs of tokens that share bytes), n_best (links whose pair of ids
    is the most frequent of its B id, ties included), count_sum (the pairs'
    counts, over links), groups_sha256. Texts that are null, empty or not given
    back by either tokenizer's tokens have zeros and an empty digest. A row for
    each row, repeats included; other columns are ignored.

    Each task counts the pairs of a block of documents before anything moves; a
    frequent word, part or pair is one record a block. Then the blocks' counts
    are merged (count_pairs) and what comes back is added up over the block's
    documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = written(_blocks(rows, path_a, path_b), "token-blocks")
    n = blocks.filter("radix = -1").count()
    answers = count_pairs(blocks.filter("radix >= 0").select(F.col("block").alias("node"), "radix", "first", "run"), n)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        held = left["docs"][0].as_py()
        listed, n_words, n_parts, n_pairs = struct.unpack_from("<QQQQ", held)
        table = pa.ipc.open_stream(memoryview(held)[32 : 32 + listed]).read_all()
        words, sizes, pair = _unpacked(held[32 + listed :], ("<u4", n_words), ("<u4", n_parts), ("<u4", n_pairs))
        found = [(first.as_py(), *_answered(x.as_py(), False)[1:]) for first, x in zip(right["first"], right["answer"], strict=True)]
        counts, best = np.zeros(sum(len(x[1]) for x in found), np.int64), np.zeros(sum(len(x[1]) for x in found), np.int64)
        for first, c, b in found:
            counts[first : first + len(c)], best[first : first + len(c)] = c, b
        ends, doc_ends = np.cumsum(sizes, dtype=np.int64), np.cumsum(table["parts"].to_numpy())
        out = []
        for values in (best, counts):
            s = np.concatenate([[0], np.cumsum(values[pair])])
            of_part = s[ends] - s[ends - sizes]
            s = np.concatenate([[0], np.cumsum(of_part[words])])
            out.append(pa.array(s[doc_ends] - s[doc_ends - table["parts"].to_numpy()], pa.int64()))
        return pa.table([table["id"], table["n_a"], table["n_b"], table["n_groups"], table["n_links"], *out, table["sha"]], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    held = blocks.filter("radix = -1").select(F.col("block").alias("node"), "docs")
    out = held.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(add_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
