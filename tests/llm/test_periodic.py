"""Runs of words against every stretch of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import periodic
from plumbline.llm.queries import QUERIES


def brute(words, least=6, repeats=4):
    """Every stretch that keeps a period and can't be made longer, if no smaller period holds in it."""
    x, found = np.unique(np.array(words, object).astype(str), return_inverse=True)[1], {}
    for q in range(1, len(x) // repeats + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], x[:-q] == x[q:], [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words):
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, np.int64)
    return periodic.runs_of(codes, np.zeros(len(words), np.int64))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words(letters, monkeypatch):
    made = random.Random(letters)
    for long in (2048, 30):  # by words, and by grams
        monkeypatch.setattr(periodic, "LONG", long)
        for _ in range(150):
            words = made.choices("abcdef"[:letters], k=made.randrange(0, 90))
            for _ in range(made.randrange(4)):
                at, p = made.randrange(len(words) + 1), made.randrange(1, 12)
                words[at:at] = (made.choices("abcdefgh", k=p) * 9)[: made.randrange(3 * p, 7 * p)]
            assert runs_of(words) == brute(words), words


def test_owners_are_apart():
    codes = np.zeros(12, np.int64)
    assert periodic.runs_of(codes, np.repeat([0, 1], 6)) == [(0, 6, 1), (6, 6, 1)]
    assert periodic.runs_of(codes, np.repeat([0, 1, 2], 4)) == []


def test_long_runs():
    """A period of one over 300,000 words, a long period within random words, and nested periods, in little time."""
    rng = np.random.default_rng(0)
    assert periodic.runs_of(np.zeros(300_000, np.int64), np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    x = rng.integers(0, 50, 100_000)
    x[20_000:84_321] = np.resize(x[20_000:33_000], 64_321)
    got = [r for r in periodic.runs_of(x, np.zeros(len(x), np.int64)) if r[2] > 100]
    assert len(got) == 1 and got[0][2] == 13_000 and got[0][0] <= 20_000 and got[0][0] + got[0][1] >= 84_321
    inner = [*[7] * 10, 1, 2]
    assert runs_of([str(w) for w in inner * 6]) == brute([str(w) for w in inner * 6])


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(expected(*d) for d in docs) and any(r[1] for r in rows)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows, ties, long texts, other columns; any run may reach the ends."""
    rows = [(1, None), (2, ""), (None, "x " * 9), (4, " \t\n"), (5, "a b " * 4 + "c c c c c c"), (6, "x " * 100_000), (7, "é  é\té\né\x0bé\x0cé"), (7, "é  é\té\né\x0bé\x0cé"), (8, "x x x x x"), (9, "p q p q p q p q p r r r r r r"), (10, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb")]
    docs = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, text string, runs string, start int")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    spans = {k: [tuple(x) for x in r.runs] for k, r in got.items()}
    assert spans == {1: [], 2: [], None: [(0, 9, 1)], 4: [], 5: [(0, 8, 2), (8, 6, 1)], 6: [(0, 100_000, 1)], 7: [(0, 6, 1)], 8: [], 9: [(0, 9, 2), (9, 6, 1)], 10: [(0, 6, 1)]}
    assert got[5].collapsed == "a b c" and got[1].collapsed == "" and got[6].collapsed == "x" and got[9].collapsed == "p q r"
    assert periodic.periodic_runs(docs).count() == len(rows) and periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, repeats=2)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
