"""LM scoring: a Katz backoff bigram model with Good-Turing discounts, counted and evaluated by blocks.

Tokens are numbers long before they are compared: a block of documents keeps
its own dictionary, asks the word table for global word numbers, and asks the
bigram table for the counts of its distinct pairs. Requests and answers are
packed arrays, one row for each block and bucket, so that a common word costs
one entry a block. Word numbers fall with frequency; so the number gives the
count, by the table of count classes, which has at most sqrt(2 N) rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import texts, written

#: Tokens of a block, and of the work of one bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 2_000_000
#: A history seen more often is dealt over several buckets, by the next word.
HOT_TOKENS = 200_000
#: Counts up to this one get Good-Turing discounts; higher ones keep all but a thousandth.
MOST_DISCOUNTED, REST = 5, 0.999
#: No word contains a space.
END = xxhash.xxh64_intdigest(b" ")
UNKNOWN = 0xFFFFFFFF


def packed(a: np.ndarray) -> bytes:
    """The array's bytes by place value, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def good_turing(classes: dict[int, int]) -> np.ndarray:
    """Discounts d[0..MOST_DISCOUNTED] from the number of items seen r times; where Katz's formula leaves (0, 1), (r - 1/2) / r."""
    n = [classes.get(r, 0) for r in range(MOST_DISCOUNTED + 2)]
    d = np.ones(MOST_DISCOUNTED + 1)
    rest = (MOST_DISCOUNTED + 1) * n[MOST_DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST_DISCOUNTED + 1):
        made = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest != 1 else 0.0
        d[r] = made if 0 < made < 1 else (r - 0.5) / r
    return d


@dataclass
class Words:
    """The word table's classes: counts in falling order and the number of words up to each."""

    counts: np.ndarray
    upto: np.ndarray

    def __post_init__(self) -> None:
        self.total = int((self.counts * np.diff(self.upto, prepend=0)).sum())
        self.size = int(self.upto[-1]) if len(self.upto) else 0
        d = good_turing(dict(zip(self.counts.tolist(), np.diff(self.upto, prepend=0).tolist(), strict=True)))
        self.p = discounted(self.counts, d) / max(self.total, 1)
        self.p_unknown = 1 - float((self.p * np.diff(self.upto, prepend=0)).sum())

    def _of(self, ids: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
        if not len(values):
            return np.full(len(ids), missing)
        at = np.minimum(np.searchsorted(self.upto, ids, "right"), len(values) - 1)
        return np.where(ids == UNKNOWN, missing, values[at])

    def count(self, ids: np.ndarray) -> np.ndarray:
        return self._of(ids, self.counts, 0).astype(np.int64)

    def probability(self, ids: np.ndarray) -> np.ndarray:
        return self._of(ids, self.p, self.p_unknown)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= MOST_DISCOUNTED, d[np.minimum(counts, MOST_DISCOUNTED)], REST) * counts


def _encode(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, end = xxhash.xxh64_intdigest, np.array([END], np.uint64)
        for batch in batches:
            docs, hashes, tokens = [], [], 0
            ids, keys = batch.column("id").to_pylist(), batch.column("fold").to_pylist()
            for k, text in enumerate(texts(batch.column("text"))):
                own = np.array([digest(w) for w in text.lower().split()], np.uint64)
                docs.append((ids[k], len(own) + 1, keys[k] == held, keys[k] is not None and keys[k] != held))
                hashes += [own, end]
                tokens += len(own) + 1
                if tokens >= BLOCK_TOKENS or k == len(ids) - 1:
                    yield _block(docs, np.concatenate(hashes).view(np.int64), batch.schema.field("id").type)
                    docs, hashes, tokens = [], [], 0

    return run


def _block(docs: list[tuple], hashes: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    words, codes, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # small codes for frequent words pack well
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    codes, words = rank[codes], words[order]
    sizes = np.array([n for _, n, _, _ in docs], np.int64)
    learn = np.repeat([x for *_, x in docs], sizes)
    n = np.bincount(codes[learn], minlength=len(words)).astype(np.uint32)
    row = {
        "ids": pa.array([[d[0] for d in docs]], pa.list_(kind)), "held": pa.array([[d[2] for d in docs]]), "learn": pa.array([[d[3] for d in docs]]),
        "sizes": pa.array([packed(sizes)]), "words": pa.array([packed(words)]), "codes": pa.array([packed(codes)]), "n": pa.array([packed(n)]),
        "tokens": pa.array([len(codes)], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in it, in order)"""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1))
    start = 0
    for end in ends.tolist():
        yield int(bucket[order[start]]), order[start : end + 1]
        start = end + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "n")), strict=True):
                words, n = unpacked(words, np.int64), unpacked(n, np.uint32)
                rows = [(b, block, packed(words[at]), packed(n[at])) for b, at in _by_bucket(np.mod(words, buckets))]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "words", "n"])

    return run


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    words = np.concatenate([unpacked(b, np.int64) for b in rows["words"]])
    n = np.concatenate([unpacked(b, np.uint32) for b in rows["n"]])
    distinct, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, n, minlength=len(distinct)).astype(np.int64)
    return pd.DataFrame({"word": distinct[total > 0], "count": total[total > 0]})


def _number_words(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    known = known.sort_values("word")
    words, numbers = known["word"].to_numpy(), known["number"].to_numpy()
    out = []
    for asked in rows["words"]:
        asked = unpacked(asked, np.int64)
        at = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
        out.append(packed(np.where(words[at] == asked, numbers[at], UNKNOWN).astype(np.uint32) if len(words) else np.full(len(asked), UNKNOWN, np.uint32)))
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "numbers": out})


class Pairs:
    """A block's tokens as word numbers, and its distinct pairs of known words as requests by bucket."""

    def __init__(self, row: dict, words: Words, end: int, buckets: int):
        hashes, codes = unpacked(row["words"], np.int64), unpacked(row["codes"], np.uint32)
        self.sizes = unpacked(row["sizes"], np.int64)
        numbers, told = np.full(len(hashes), UNKNOWN, np.uint32), {x["bucket"]: x["numbers"] for x in row["told"]}
        for b, at in _by_bucket(np.mod(hashes, buckets)):
            numbers[at] = unpacked(told[b], np.uint32)
        self.token = numbers[codes]
        self.history = np.empty_like(self.token)
        self.history[1:], self.history[0] = self.token[:-1], end  # a document follows the end of another
        self.known = np.flatnonzero((self.token != UNKNOWN) & (self.history != UNKNOWN))
        pairs = self.history[self.known].astype(np.uint64) << np.uint64(32) | self.token[self.known]
        self.pairs, self.at = np.unique(pairs, return_inverse=True)
        learn = np.repeat(np.array(row["learn"], bool), self.sizes)[self.known]
        self.n = np.bincount(self.at[learn], minlength=len(self.pairs)).astype(np.uint32)
        self.u, self.w = (self.pairs >> np.uint64(32)).astype(np.uint32), self.pairs.astype(np.uint32)
        self.histories = np.unique(self.history[self.history != UNKNOWN])
        # A history that is dealt over buckets, or that an unknown word follows, asks all its buckets for their sums.
        lone = np.isin(self.histories, self.history[(self.token == UNKNOWN) & (self.history != UNKNOWN)])
        parts = parts_of(words.count(self.histories))
        forced, parts = self.histories[lone | (parts > 1)], parts[lone | (parts > 1)]
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        forced = np.repeat(forced, parts)
        self.forced = {b: np.unique(forced[at]) for b, at in _by_bucket(bucket_of(forced, part, buckets))}
        own = (_mix(self.w) % parts_of(words.count(self.u)).astype(np.uint64)).astype(np.int64)
        self.asked = dict(_by_bucket(bucket_of(self.u, own, buckets)))

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """bucket, positions of its pairs, their histories, and those that ask for sums in any case."""
        for b in sorted({*self.asked, *self.forced}):
            at, forced = self.asked.get(b, np.empty(0, np.int64)), self.forced.get(b, np.empty(0, np.uint32))
            histories = np.union1d(self.u[at], forced).astype(np.uint32)
            yield b, at, histories, np.isin(histories, forced)


def parts_of(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-counts // HOT_TOKENS))


def bucket_of(u: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(_mix(u) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _pair_requests(words: Words, end: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made, rows = Pairs(row, words, end, buckets), []
                for b, at, histories, forced in made.requests():
                    sizes = np.searchsorted(made.u[at], histories, "right") - np.searchsorted(made.u[at], histories, "left")
                    rows.append((b, row["block"], packed(histories), packed(sizes.astype(np.uint32)), packed(made.w[at]), packed(made.n[at]), packed(forced)))
                if rows:
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "u", "sizes", "w", "n", "forced"])

    return run


MODEL, ANSWER = 0, 1
TOLD = "kind int, bucket int, block long, a binary, b binary, c binary, d binary, classes array<long>"


def _count_pairs(words: Words):
    """For one bucket: the model's row (pairs, counts, numbers of pairs by count), and each block's answer.

    An answer holds the count of each pair asked for. Of histories that need
    it, because a pair is new or they ask for it in any case, it also
    holds the number of followers seen 1..MOST_DISCOUNTED times and the sum of
    all followers' unigram probabilities, in this bucket.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = []
        for u, sizes, w in zip(rows["u"], rows["sizes"], rows["w"], strict=True):
            u, sizes = unpacked(u, np.uint32), unpacked(sizes, np.uint32)
            asked.append((u, sizes, np.repeat(u, sizes).astype(np.uint64) << np.uint64(32) | unpacked(w, np.uint32)))
        n = np.concatenate([unpacked(b, np.uint32) for b in rows["n"]])
        pairs, at = np.unique(np.concatenate([k for *_, k in asked]), return_inverse=True)
        count = np.bincount(at, n, minlength=len(pairs)).astype(np.int64)
        pairs, count = pairs[count > 0], count[count > 0]
        owner = (pairs >> np.uint64(32)).astype(np.uint32)
        histories, start = np.unique(owner, return_index=True)
        seen, total = np.zeros((len(histories), MOST_DISCOUNTED), np.uint32), np.zeros(len(histories))
        if len(pairs):
            for r in range(1, MOST_DISCOUNTED + 1):
                seen[:, r - 1] = np.add.reduceat((count == r).astype(np.uint32), start)
            total = np.add.reduceat(words.probability(pairs.astype(np.uint32)), start)
        classes = np.bincount(np.minimum(count, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3).astype(np.int64)
        bucket = int(rows["bucket"].iloc[0])
        out = [(MODEL, bucket, None, packed(pairs), packed(count), None, None, classes.tolist())]
        for block, (u, sizes, keys), forced in zip(rows["block"], asked, rows["forced"], strict=True):
            if len(pairs):
                k = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                c = np.where(pairs[k] == keys, count[k], 0)
            else:
                c = np.zeros(len(keys), np.int64)
            ends = np.cumsum(sizes.astype(np.int64))
            new = np.concatenate([[0], np.cumsum(c == 0)])
            need = (new[ends] > new[ends - sizes]) | unpacked(forced, bool)
            told = np.minimum(np.searchsorted(histories, u[need]), max(len(histories) - 1, 0))
            has = (histories[told] == u[need]) if len(histories) else np.zeros(len(told), bool)
            m = np.where(has[:, None], seen[told], 0) if len(histories) else np.zeros((len(told), MOST_DISCOUNTED), np.uint32)
            s = np.where(has, total[told], 0.0) if len(histories) else np.zeros(len(told))
            out.append((ANSWER, bucket, block, packed(c.astype(np.int64)), packed(need), packed(m.astype(np.uint32).ravel()), packed(s), None))
        return pd.DataFrame(out, columns=["kind", "bucket", "block", "a", "b", "c", "d", "classes"]).astype({"block": "Int64"})

    return run


def _score(words: Words, end: int, buckets: int, d: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made, answers = Pairs(row, words, end, buckets), {x["bucket"]: x for x in row["answers"] or ()}
                count = np.zeros(len(made.pairs), np.int64)
                seen, mass = np.zeros((len(made.histories), MOST_DISCOUNTED)), np.zeros(len(made.histories))
                for b, at, asked, _ in made.requests():
                    x = answers[b]
                    count[at] = unpacked(x["a"], np.int64)
                    told = np.searchsorted(made.histories, asked[unpacked(x["b"], bool)])
                    seen[told] += unpacked(x["c"], np.uint32).reshape(-1, MOST_DISCOUNTED)
                    mass[told] += unpacked(x["d"], np.float64)
                # what the discounts take from a history is what its unseen followers share, by their unigram probabilities
                n = words.count(made.histories)
                r = np.arange(1, MOST_DISCOUNTED + 1)
                freed = (seen * r * (1 - d[1:])).sum(1) + (1 - REST) * (n - (seen * r).sum(1))
                weight = freed / np.maximum(n, 1) / (1 - mass)
                p = words.probability(made.token)
                backed = made.history != UNKNOWN
                p[backed] *= weight[np.searchsorted(made.histories, made.history[backed])]
                seen_at = count[made.at]
                hit = seen_at > 0
                p[made.known[hit]] = discounted(seen_at[hit], d) / words.count(made.history[made.known[hit]])
                starts = np.cumsum(made.sizes) - made.sizes
                c = words.count(made.token)
                sums = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
                arrays = [
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(row["held"]), pa.array(made.sizes), pa.array(sums((c > 0).astype(np.int64))),
                    pa.array(np.full(len(starts), words.total)), pa.array(sums(np.log10((c + 1) / (words.total + words.size + 1)))), pa.array(sums(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def word_numbers(counts: DataFrame) -> DataFrame:
    """word, count, number: 0 for the most frequent word, dense, ties by word; written."""
    ranked = written(counts.orderBy(F.desc("count"), "word").withColumn("at", F.monotonically_increasing_id()), "words")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, start = [], 0
    for k, n in sizes:
        starts += [F.lit(k), F.lit(start)]
        start += n
    if start >= UNKNOWN:
        raise ValueError(f"{start} distinct words; a number has 32 bits")
    first = F.create_map(*starts)[part] if starts else F.lit(0)
    return ranked.select("word", "count", (first + place).cast("long").alias("number"))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Base-10 log probabilities of whole texts under a bigram model of the documents outside the held-out fold.

    Tokens are the words without ASCII white space, A-Z lower-cased, and one
    end; the first token follows an end. A pair seen r times among n of its
    history has d(r) r / n; other words share what the discounts free, by
    their unigram probability, so that each history's probabilities sum to 1.
    Unigrams are discounted alike; what is freed goes to unknown words as one
    event. The fold is crc32 of the id as text; a null id is in no fold and is
    scored, not learned from. Null texts count as empty, repeated rows count
    and are scored each, other columns are ignored.

    Pairs go to buckets by their history, or by both words where the history
    is frequent, so no bucket grows with one word. The word and pair tables
    stay written in the shared folder by bucket.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams), score.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.crc32(F.col(id_col).cast("string")) % folds).alias("fold"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_encode(held_out), f"ids array<{kind}>, held array<boolean>, learn array<boolean>, sizes binary, words binary, codes binary, n binary, tokens long")
    blocks = written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    buckets = max(1, math.ceil((blocks.agg(F.sum("tokens")).first()[0] or 0) / BUCKET_TOKENS))
    asked = blocks.select("block", "words", "n").mapInArrow(_word_requests(buckets), "bucket int, block long, words binary, n binary")
    known = word_numbers(asked.groupBy("bucket").applyInPandas(_count_words, "word long, count long"))
    classes = sorted(((r["count"], r["n"]) for r in known.groupBy("count").agg(F.count("*").alias("n")).collect()), reverse=True)  # at most sqrt(2 N) rows
    words = Words(np.array([c for c, _ in classes], np.int64), np.cumsum(np.array([n for _, n in classes], np.int64)))
    at_end = known.filter(F.col("word") == int(np.uint64(END).view(np.int64))).select("number").first()
    end = at_end[0] if at_end else UNKNOWN
    numbers = known.select("word", "number", F.pmod("word", F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket")
    told = written(asked.groupBy("bucket").cogroup(numbers).applyInPandas(_number_words, "block long, bucket int, numbers binary"), "numbers")
    told = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "numbers")).alias("told"))
    requests = blocks.join(told, "block").mapInArrow(_pair_requests(words, end, buckets), "bucket int, block long, u binary, sizes binary, w binary, n binary, forced binary")
    counted = written(requests.groupBy("bucket").applyInPandas(_count_pairs(words), TOLD), "pairs")
    seen = counted.filter(F.col("kind") == MODEL).select(F.posexplode("classes").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n"))
    d = good_turing({r["r"]: r["n"] for r in seen.collect()})
    answers = counted.filter(F.col("kind") == ANSWER).groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias("answers"))
    whole = blocks.join(told, "block").join(answers, "block", "left")
    out = whole.mapInArrow(_score(words, end, buckets, d), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
