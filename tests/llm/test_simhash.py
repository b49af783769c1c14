"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_print(text):
    words, bit_counts = (text or "").encode().lower().split(), [0] * 64
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bit_counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bit_counts[b] > len(shingles))


def brute_groups(prints):
    """{id: smallest id reachable}"""
    ids = sorted(prints)
    fps = np.array([prints[k] for k in ids], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {k: ids[label[i]] for i, k in enumerate(ids)}
        label = new


def test_query_is_all_pairs(spark):
    rows = QUERIES["op2_simhash_near_dedup"](spark, SF).collect()
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = brute_groups(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(k, f"{prints[k]:016x}", groups[k]) for k in prints}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("shard_points", [16, 8192])
def test_clusters_and_chains(spark, monkeypatch, shard_points):
    monkeypatch.setattr(simhash, "SHARD_POINTS", shard_points)
    rng = np.random.default_rng(1)
    fps = list(rng.integers(0, 1 << 63, 1500, dtype=np.uint64))
    for centre in fps[:3]:  # a dense cluster and a chain of four-bit steps
        fps += [centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(300)]
        for _ in range(20):
            centre ^= np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
            fps.append(centre)
    fps = np.unique(np.array(fps, np.uint64))
    points = spark.createDataFrame([(k, int(np.int64(f.view(np.int64)))) for k, f in enumerate(fps)], "node long, fp long")
    links = simhash.near_links(points)
    found = {r.node: r.component for r in components(links).collect()}
    assert {k: found.get(k, k) for k in range(len(fps))} == brute_groups(dict(enumerate(fps)))
    assert links.count() <= 8 * len(fps)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d", "É b", "é b", "x " * 20000]
    docs = spark.createDataFrame([(k, t, "fp", 7) for k, t in enumerate(texts)] + [(3, "a", "fp", 7), (None, "a", "", 0), (None, "only here", "", 0)], "doc_id long, text string, fp string, node int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect()}
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    groups = brute_groups(prints)
    want = {(k, f"{prints[k]:016x}", groups[k]) for k in prints}
    assert got == want | {(None, f"{brute_print('a'):016x}", 3), (None, f"{brute_print('only here'):016x}", None)}
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (10, 9), (9, 9), (None, 3), (20, 20)]
    made = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in made.collect()} == {(k, 1) for k in range(1, 8)} | {(9, 9), (10, 9)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
