"""Best-fit packing of tokenised documents, improved by swaps between underfull bins."""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .tables import texts, written

#: Pieces that one task packs; a piece is a few numbers.
SHARD_PIECES = 50_000
#: The search goes on while a pass raises the sum of squared fills by this share.
PROGRESS = 1e-4
#: Distinct words that a worker keeps; beyond it, it starts anew. Bytes of text looked through at a time.
CACHE_WORDS, TEXT_BYTES = 400_000, 1 << 20
#: ASCII marks but the apostrophe, with which some letters make one token.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Ids of a text word by word: the tokenizer drops white space, so words don't affect each other.

    The strings of the tokenizer's added tokens are those tokens wherever they
    stand in a text, in just that spelling; they are split off before the words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = {t.content.encode(): array("I", [k]).tobytes() for k, t in self.model.get_added_tokens_decoder().items()}
        self.split_added = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        self.model.encode_special_tokens = True  # of single words, from which the added tokens were split; a lower-cased lookalike is none
        self.bpe, self.shown = self.model.model, dict(enumerate(byte_characters()))
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        """The words in lower case; an added token is a word of its own after a space, which no other has."""
        if self.split_added and b"<|" in text and len(parts := self.split_added.split(text)) > 1:
            return [w for k, part in enumerate(parts) for w in ([b" " + part] if k % 2 else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: bytes) -> list[bytes]:
        if b"\xcc" not in text and b"\xcd" not in text:  # no combining marks, which join with some small letters only
            text = text.lower()
        return text.split()

    def _letters(self, word: bytes) -> bytes | None:
        """Of Latin letters, what the model makes of them: nothing else of the tokenizer changes those but their case."""
        if (ids := self.stems.get(word)) is not None:
            return ids
        letters = word.decode().lower()
        if not letters.isalpha() or max(letters) >= "\u0250":
            return None
        ids = array("I", [t.id for t in self.bpe.tokenize(letters.encode().decode("latin-1").translate(self.shown))]).tobytes()
        self.stems[word] = ids
        return ids

    def _whole(self, word: bytes) -> bytes:
        if word[:1] == b" ":
            return self.added[word[1:]]
        return array("I", self.model.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        for word in new:
            stem = word.rstrip(_MARKS)
            if stem and (ids := self._letters(stem)) is not None:  # a token ends between a letter and the marks after it
                marks = word[len(stem) :]
                if marks and (tail := known.get(marks)) is None:
                    tail = known[marks] = self._whole(marks)
                known[word] = ids + tail if marks else ids
            elif word not in known:
                known[word] = self._whole(word)

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, several: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; the tokenizer is asked for the new words of many texts at once."""
        at = 0
        while at < len(several):
            split, size = [], 0
            while at < len(several) and size < TEXT_BYTES:
                split.append(self.words(several[at]))
                size += len(several[at])
                at += 1
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                self.stems.clear()
                new = set().union(*split)
            if new:
                self._learn(new)
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and a final 0, cut into pieces of size tokens: id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = word_tokenizer(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(made.encode_all(texts(batch.column("text")))):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                for p, at in enumerate(range(0, n, size)):
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(min(size, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
            arrays = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of items by size, found by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has room r

    def _file(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        self.by_room[room].add(k)
        self.rooms |= 1 << room

    def _unfile(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        self.by_room[room].discard(k)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)

    def tightest(self, size: int, other_than: int = -1) -> int:
        """The bin with the least room for size, -1 if there is none."""
        above = self.rooms >> size
        while above:
            room = size + (above & -above).bit_length() - 1
            for k in self.by_room[room]:
                if k != other_than:
                    return k
            above = self.rooms >> (room + 1)
            size = room + 1
        return -1

    def put(self, k: int, items: list[tuple[int, int]]) -> None:
        if k < 0:
            k = len(self.items)
            self.items.append([])
            self.fill.append(0)
        else:
            self._unfile(k)
        self.items[k] += items
        self.fill[k] += sum(s for s, _ in items)
        self._file(k)

    def exchange(self, a: int, give: list[tuple[int, int]], b: int, take: list[tuple[int, int]]) -> None:
        for k, out, into in ((a, give, take), (b, take, give)):
            self._unfile(k)
            for x in out:
                self.items[k].remove(x)
            self.items[k] += into
            self.fill[k] = sum(s for s, _ in self.items[k])
            self._file(k)


class Offers:
    """Of the underfull bins, for each size (or sum of two sizes) the two roomiest that hold it; as of one moment."""

    def __init__(self, bins: Bins, open_bins: list[int], two: bool):
        self.room = np.full((2, bins.capacity + 1), -1, np.int64)
        self.bin = np.full((2, bins.capacity + 1), -1, np.int64)
        for k in open_bins:
            room = bins.capacity - bins.fill[k]
            for s in sums(bins.items[k]) if two else {s for s, _ in bins.items[k]}:
                if room > self.room[0, s]:
                    self.room[1, s], self.bin[1, s] = self.room[0, s], self.bin[0, s]
                    self.room[0, s], self.bin[0, s] = room, k
                elif room > self.room[1, s]:
                    self.room[1, s], self.bin[1, s] = room, k

    def for_size(self, size: int, own: int) -> tuple[int, int]:
        """(difference, bin): the bin but own that takes size for the smallest thing it holds in its place; (0, -1) if none can."""
        second = self.bin[0, :size] == own
        room = np.where(second, self.room[1, :size], self.room[0, :size])
        fits = np.flatnonzero(room >= size - np.arange(size))
        return (size - int(fits[0]), int(self.bin[int(second[fits[0]]), fits[0]])) if len(fits) else (0, -1)


def sums(items: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Sums of two of the items and the sizes they are made of. Distinct sizes of one bin are few: 63 in 2048."""
    sizes = sorted({s for s, _ in items})
    twice = {s for s in sizes if sum(s == t for t, _ in items) > 1}
    return {y + z: (y, z) for i, y in enumerate(sizes) for z in sizes[i:] if y != z or y in twice}


def _of_sizes(items: list[tuple[int, int]], sizes: tuple[int, ...]) -> list[tuple[int, int]] | None:
    """Items of those sizes, each another; None if they aren't there."""
    out: list[tuple[int, int]] = []
    for s in sizes:
        found = next((x for x in items if x[0] == s and x not in out), None)
        if found is None:
            return None
        out.append(found)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: best fit by falling size, then moves and swaps that raise the sum of squared fills.

    All underfull bins take part, pass after pass, until no bin can be spared,
    or a pass raises the sum by less than PROGRESS of it.
    """
    bins, least = Bins(capacity), -(-sum(sizes) // capacity)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        bins.put(bins.tightest(sizes[k]), [(sizes[k], k)])
    before, now = -1.0, float(sum(f * f for f in bins.fill))
    while sum(f > 0 for f in bins.fill) > least and now > before * (1 + PROGRESS):
        _improve(bins)
        before, now = now, float(sum(f * f for f in bins.fill))
    return [[k for _, k in x] for x in bins.items if x]


def _improve(bins: Bins) -> None:
    """One pass: the emptiest bins first, each gives away or trades what it can for less."""
    open_bins = sorted((k for k in range(len(bins.items)) if 0 < bins.fill[k] < bins.capacity), key=lambda k: bins.fill[k])
    one, two = Offers(bins, open_bins, False), Offers(bins, open_bins, True)
    for a in open_bins:
        for item in sorted(bins.items[a], reverse=True):
            b = bins.tightest(item[0], a)
            if b >= 0 and bins.fill[b] + item[0] > bins.fill[a]:
                bins.exchange(a, [item], b, [])
        best = None
        for size, give in [*(((s, (s,))) for s in {s for s, _ in bins.items[a]}), *sums(bins.items[a]).items()]:
            for offers in (one, two) if len(give) == 1 else (one,):
                d, b = offers.for_size(size, a)
                if d and (best is None or d > best[0]):
                    best = (d, b, give, size - d, offers is two)
        if best:
            d, b, give, taken, pair = best
            theirs = (sums(bins.items[b]).get(taken) if pair else (taken,)) if bins.items[b] else None
            mine, theirs = _of_sizes(bins.items[a], give), theirs and _of_sizes(bins.items[b], theirs)
            # what was offered may be gone since
            if mine and theirs and bins.fill[b] + d <= bins.capacity and bins.fill[b] + d > bins.fill[a]:
                bins.exchange(a, mine, b, theirs)


def _pack_shard(capacity: int, high: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        base = high | int(rows["shard"].iloc[0]) << 24
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, bin_ in enumerate(pack(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = base | k, at
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset).drop(columns="shard")

    return run


def best_fit_pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Packs pieces into as few sequences of at most size tokens as it can.

    Pieces are dealt evenly to tasks of about SHARD_PIECES, which pack by best
    fit and local search. Bins that are at most half full (one at most from
    each task) are then packed together, again in tasks of bounded size.

    pieces needs length, 1 to size; its other columns stay. Adds sequence_id
    and offset. Ties are free; repeated pieces are packed each; an empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = []
    todo, high = pieces, 0
    for round_ in range(2):
        shards = max(1, math.ceil(todo.count() / SHARD_PIECES))
        schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"]
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("nth"), F.lit(shards)))
        packed = written(dealt.groupBy("shard").applyInPandas(_pack_shard(size, round_ << 62), ", ".join(schema)), "packed")
        if round_ or shards == 1:
            done.append(packed)
            break
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        loose = written(fills.filter(F.col("fill") <= size // 2).select("sequence_id"), "loose")
        done.append(packed.join(loose, "sequence_id", "left_anti").select(packed.columns))
        todo = packed.join(loose, "sequence_id", "left_semi").select(pieces.columns)
    out = functools.reduce(DataFrame.unionByName, done)
    return out.drop("nth")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs every document.

    A document is its ids and a final 0 (null and empty texts: only the 0);
    only documents of more than size tokens are cut. Returns id_col, piece,
    start, length, ids_crc32, sequence_id, offset, one row for each piece;
    rows repeated in docs are packed each, other columns are ignored.
    """
    packed = best_fit_pack(token_pieces(docs, path, size, id_col, text_col), size)
    return packed.withColumnRenamed("id", id_col)
