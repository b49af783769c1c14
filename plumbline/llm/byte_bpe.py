"""Byte-level BPE: encode whole texts with the tokenizers library, decode by the byte table."""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import texts

#: Distinct text parts that a worker keeps encoded; beyond it, it starts anew.
CACHE_PARTS = 300_000
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts that the token pattern never crosses: a word with the space before it; white space up to the last of a run.
_PARTS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Ranks of byte strings as a tokenizers BPE model, and its inverse."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            self.token = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
        shown = byte_characters()
        self.shown = {b: c for b, c in enumerate(shown)}
        vocab = {"".join(shown[b] for b in t): rank for rank, t in self.token.items()}
        names = {rank: name for name, rank in vocab.items()}
        merges = []
        for rank in sorted(names):  # every split of a token into two tokens may be merged, at the token's rank
            name = names[rank]
            merges += [(name[:k], name[k:]) for k in range(1, len(name)) if name[:k] in vocab and name[k:] in vocab]
        self.model = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
        self.pattern = regex.compile(pattern)
        self.size = np.zeros(max(self.token) + 1, np.int64)
        for rank, t in self.token.items():
            self.size[rank] = len(t)
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        owners, pieces = [], []
        for part in parts:
            for piece in self.pattern.findall(part):
                owners.append(part)
                pieces.append(piece.encode().decode("latin-1").translate(self.shown))
        if not pieces:
            return
        made = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(made.ids, "<u4"), np.array(made.word_ids, np.int64)
        ends = np.searchsorted(word, np.arange(len(pieces)), "right")
        start = k = 0
        while k < len(owners):
            part = owners[k]
            while k < len(owners) and owners[k] is part:
                end = ends[k]
                k += 1
            self.known[part] = ids[start:end].tobytes()
            start = end

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = _PARTS.findall(text)
        known = self.known
        if new := {p for p in parts if p not in known}:
            if len(known) + len(new) > CACHE_PARTS:
                known.clear()
                new = set(parts)
            self._learn(new)
        return b"".join([known[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode_parts(self, ids: list[int]) -> list[str]:
        """The text that each id completes; a character split over ids comes with its last one, a broken one as U+FFFD."""
        step = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [step.decode(self.token[i]) for i in ids]
        return [*parts[:-1], parts[-1] + step.decode(b"", True)] if parts else []

    def starts(self, ids: bytes, data: bytes) -> tuple[np.ndarray, int]:
        """The character in which each token starts, and how many start inside one."""
        sizes = self.size[np.frombuffer(ids, "<u4")]
        at = np.cumsum(sizes) - sizes
        first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first)[at] - 1).astype(np.int32), int((~first[at]).sum())


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of token ids) and starts (character offset of each token) of every whole text.

    Null and empty texts have no ids; other columns are ignored; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            ids, starts = [], []
            for data in texts(batch.column("text")):
                ids.append(np.frombuffer(packed := made.encode(data.decode()), "<u4"))
                starts.append(made.starts(packed, data)[0])
            arrays = [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "starts"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and text (bytes) from ids; null ids give null, no ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            out = [None if x is None else made.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids in one pass.

    Returns id_col, n_tokens, ids_sha256 (of little-endian 32-bit ids),
    decoded_sha256 (of the decoded bytes), n_split (tokens that start inside a
    character), last_start (character offset of the last token; null without
    tokens). Null texts count as empty: no tokens, digests of no bytes. One
    row for each row, repeats included; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, split, last = [], [], [], [], []
            for data in texts(batch.column("text")):
                ids = made.encode(data.decode())
                decoded = made.decode(ids)
                starts, inside = made.starts(ids, decoded)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                split.append(inside)
                last.append(int(starts[-1]) if len(starts) else None)
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(split, pa.int64()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "last_start"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, last_start int")
    return out.withColumnRenamed("id", id_col)
