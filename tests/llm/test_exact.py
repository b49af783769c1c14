"""Exact copies against grouping by the text itself."""

import hashlib
from collections import defaultdict

from plumbline.llm import exact_dedup as ex
from plumbline.llm.queries import QUERIES


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    return groups


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups = brute(docs)
    want = {(k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in docs}
    assert {tuple(r) for r in QUERIES["op9_exact_dedup"](spark, sf).collect()} == want


def test_odd_rows(spark):
    long = "wörd " * 60_000
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a"), (None, "b"), (5, long), (6, long), (7, long + "x"), (8, " " + long)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, hash string, row int")
    got = sorted((tuple(r)[:4] for r in ex.exact_dedup(docs).collect()), key=str)
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (None, None, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert got == sorted(want, key=str)
    assert ex.exact_dedup(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.kept for r in ex.exact_dedup(twice).collect()) == [False, True]


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    chunks = [("k", [(5, 3, b"one")]), ("l", [(5, 3, b"two")]), ("m", [(5, 3, b"one")])]
    made = spark.createDataFrame([(k, c, str(c), i) for i, (k, c) in enumerate(chunks)], "id string, chunks array<struct<hash:long,n:int,digest:binary>>, text_sha256 string, row long")
    monkeypatch.setattr(ex, "chunk_recipes", lambda *_: made)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ex.exact_dedup(None).collect()}
    assert got == {"k": ("m", 2), "l": ("l", 1), "m": ("m", 2)}


def test_chunks_follow_content():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    mask = lambda h: np.flatnonzero((h >> np.uint32(32 - ex.MEAN_BITS)) == 0) + 1
    ends = ex.cut_points(mask(ex.rolling_hash(data)), 0, len(data))
    moved = np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), data])
    later = ex.cut_points(mask(ex.rolling_hash(moved)), 0, len(moved))
    assert len({e + 777 for e in ends} & set(later)) > 0.9 * len(ends)
    assert ends[-1] == len(data) and all(0 < b - a <= ex.MAX_BYTES for a, b in zip([0, *ends], ends, strict=False))
