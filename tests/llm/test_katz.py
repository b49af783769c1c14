"""Katz scores against dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import katz
from plumbline.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def discounts(counts):
    return katz.good_turing(Counter(counts))


def gt(c, d):
    return (d[c] if c <= katz.MOST_DISCOUNTED else katz.REST) * c


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            u = b" "
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[u][w] += 1
                u = w
        self.n = sum(self.uni.values())
        d1 = discounts(self.uni.values())
        self.p1 = {w: gt(c, d1) / self.n for w, c in self.uni.items()}
        self.rest = 1 - sum(self.p1.values())
        self.d2 = discounts([c for f in self.bi.values() for c in f.values()])
        self.alpha = {}
        for u, f in self.bi.items():
            left = 1 - sum(gt(c, self.d2) for c in f.values()) / self.uni[u]
            self.alpha[u] = left / (1 - sum(self.p1[w] for w in f))

    def p(self, w, u):
        if c := self.bi.get(u, {}).get(w):
            return gt(c, self.d2) / self.uni[u]
        return self.alpha.get(u, 1.0) * self.p1.get(w, self.rest)


def check(rows, docs):
    model = Brute([t for k, t in docs if k is not None and zlib.crc32(str(k).encode()) % 7 != 2])
    want = []
    for k, t in docs:
        own, u, score, base = tokens(t), b" ", 0.0, 0.0
        for w in own:
            score += math.log10(model.p(w, u))
            base += math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1))
            u = w
        want.append((k, k is not None and zlib.crc32(str(k).encode()) % 7 == 2, len(own), sum(model.uni[w] > 0 for w in own), model.n, base, score))
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for got, exp in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:5] == exp[:5]
        assert got[5] == pytest.approx(exp[5], rel=1e-9) and got[6] == pytest.approx(exp[6], rel=1e-9)
    return model


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op10_katz_scores"](spark, sf).collect()
    model = check(rows, docs)
    for u in list(model.bi)[:40]:  # exactly normalised
        assert sum(model.p(w, u) for w in model.uni) + model.alpha[u] * model.rest == pytest.approx(1, abs=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hot_histories_and_small_blocks(spark, monkeypatch):
    for name, value in (("HOT_TOKENS", 7), ("BLOCK_TOKENS", 40), ("BUCKET_TOKENS", 150)):
        monkeypatch.setattr(katz, name, value)
    rng = np.random.default_rng(0)
    docs = [(k, " ".join(["the" if x < 3 else f"w{x}" for x in rng.zipf(1.4, 25)])) for k in range(80)]
    docs += [(None, "the w9 the"), (100, None), (101, ""), (102, "Unseen the unseen2 unseen3"), (102, "the the"), (103, "the " * 500)]
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, block int, words string")
    check(katz.katz_scores(table.repartition(3)).collect(), docs)


def test_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(nothing).count() == 0
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = katz.katz_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_packed():
    for a in (np.arange(1000, dtype=np.uint32), np.array([], np.int64), np.array([True, False]), np.random.default_rng(1).integers(-9, 9, 50)):
        assert (katz.unpacked(katz.packed(a), a.dtype) == a).all()


def test_counts_beyond_32_bits():
    """Counts that blocks send add up, and come back, in 64 bits."""
    words = katz.Words(np.array([5_000_000_000]), np.array([2]))
    one = lambda a, kind: katz.packed(np.array(a, kind))
    rows = pd.DataFrame({"bucket": [0, 0], "block": [1, 2], "u": [one([0], np.uint32)] * 2, "sizes": [one([1], np.uint32)] * 2, "w": [one([1], np.uint32)] * 2, "n": [one([4_000_000_000], np.uint32)] * 2, "forced": [one([False], bool)] * 2})
    made = katz._count_pairs(words)(rows)
    answers = made[made["kind"] == katz.ANSWER]
    assert [katz.unpacked(a, np.int64).tolist() for a in answers["a"]] == [[8_000_000_000]] * 2
