"""Audio fingerprints: noise, offsets, and recall against comparing all pairs."""

import numpy as np
import pytest

from plumbline.llm import chroma as ch
from plumbline.llm.queries import QUERIES


def song(notes, rate=ch.RATE):
    t = np.arange(2 * ch.HOP) / rate
    return np.concatenate([100 * np.sin(2 * np.pi * ch.LOWEST * 2 ** (k / 12) * t) for k in notes]).astype(np.int8)


def error(a, b):
    n = min(len(a), len(b))
    return np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)


def test_noise_and_offset():
    rng = np.random.default_rng(0)
    notes = rng.integers(0, 12, 60)
    clean = song(notes)
    noisy = np.clip(clean + rng.normal(0, 6, len(clean)), -127, 127).astype(np.int8)
    other = song(rng.integers(0, 12, 60))
    a = ch.fingerprint(clean)
    assert error(a, ch.fingerprint(noisy)) < 0.08 < 0.25 < error(a, ch.fingerprint(other))
    late = ch.fingerprint(np.concatenate([song(rng.integers(0, 12, 5)), clean]))
    assert error(a, late[10:]) < 0.01
    assert len(ch.fingerprint(np.zeros(10, np.int8))) == 0


def brute(one, two):
    """{offset: (start, frames)} of stretches of LEAST_FRAMES frames or more with at most MOST_ERROR wrong bits, by all offsets: of each, the one with the most bits to spare."""
    offsets, i = np.arange(ch.LEAST_FRAMES - len(one), len(two) - ch.LEAST_FRAMES + 1), np.arange(len(one))
    if not len(offsets) or not len(one) or not len(two):
        return {}
    at = i + offsets[:, None]
    wrong = np.where((at >= 0) & (at < len(two)), np.bitwise_count(one ^ two[np.clip(at, 0, len(two) - 1)]), 1000)
    spare = np.concatenate([np.zeros((len(offsets), 1)), np.cumsum(ch.MOST_ERROR * 32 - wrong, 1)], 1)
    least = np.minimum.accumulate(spare, 1)
    end = np.argmax(np.round(spare - least, 6), 1)
    lower = np.concatenate([np.ones((len(offsets), 1), bool), np.round(spare[:, 1:], 6) < np.round(least[:, :-1], 6)], 1)
    start = np.maximum.accumulate(np.where(lower, np.arange(spare.shape[1]), 0), 1)[np.arange(len(end)), end]
    return {int(o): (int(a), int(b - a)) for o, a, b in zip(offsets, start, end, strict=True) if b - a >= ch.LEAST_FRAMES}


def check(rows, queries, prints):
    """Every row is right, and 0.9 or more of the pairs with a match are there. Pairs are of classes: a match has the smallest id of its print."""
    classes = {}
    for k in sorted(prints, key=lambda k: (k is not None, k)):
        classes.setdefault(prints[k].tobytes(), k)
    want = {(q, r): got for q in queries for r in {classes[x.tobytes()] for x in prints.values() if len(x)} if (got := brute(queries[q], prints[r]))}
    found = {}
    for r in rows:
        found.setdefault((r[0], r[1]), []).append(r)
        assert r.bit_error <= ch.MOST_ERROR and r.frames >= ch.LEAST_FRAMES and r.hits >= ch.LEAST_HITS
        start, frames = want[r[0], r[1]][r.offset]
        assert (r.start, r.frames) == (start, frames)
        wrong = np.bitwise_count(queries[r[0]][start : start + frames] ^ prints[r[1]][start + r.offset : start + r.offset + frames]).sum()
        assert abs(r.bit_error - wrong / 32 / frames) < 1e-9
    for (q, r), rows in found.items():
        offsets = sorted(x.offset for x in rows)
        assert all(y - x >= ch.WIDTH for x, y in zip(offsets, offsets[1:], strict=False)), (q, r)
    assert len(found) >= 0.9 * len(want), (len(found), len(want))
    return want, found


def prints_of(df, *ids):
    return {(r[ids[0]] if len(ids) == 1 else tuple(r[c] for c in ids)): np.frombuffer(bytes(r["print"]), "<u4") for r in df.collect()}


@pytest.mark.parametrize("n", [250, 300, 600])
def test_common_passage_in_noise(spark, n):
    """What is found does not depend on how many recordings share a passage: noisy excerpts of five meet all n."""
    rng = np.random.default_rng(1)
    make = lambda k, v="w": [f"{v}{x}" for x in rng.integers(0, 10**6, k)]
    shared = make(31, "p")
    docs = spark.createDataFrame([(k, " ".join([*make(30), *shared, *make(30)])) for k in range(n)], "id long, text string")
    made = ch.rendered_fingerprints(docs, ["id"], "text")
    asked = ch.rendered_fingerprints(docs.filter("id < 5"), ["id"], "text", excerpts=True)
    got = {(r.id, r.match.id) for r in ch.align(made, asked, ["id"]).collect()}
    prints, queries = prints_of(made, "id"), prints_of(asked, "id")
    some = range(0, n, 7)
    want = {(q, r) for q in queries for r in some if brute(queries[q], prints[r])}
    assert len(want) >= 0.9 * 5 * len(some) and len(want & got) >= 0.9 * len(want) and len(got) >= 0.9 * 5 * n


@pytest.mark.parametrize("noise", [True, False])
def test_recall_against_all_pairs(spark, noise):
    """Shared passages in the middle of others, two stretches around a changed middle, repeated words, copies; excerpts with noise, or clean sound."""
    rng = np.random.default_rng(4)
    make = lambda n, v="w": [f"{v}{x}" for x in rng.integers(0, 10**6, n)]
    base = [make(80) for _ in range(30)]
    phrase = make(40, "p")
    docs = [*base, *([*x[10:70], *make(20)] for x in base), *([*make(15), *phrase, *make(30)] for _ in range(20))]
    docs += [[*x[:40], *make(20), *x[60:], *make(3)] for x in base[:10]]
    docs += [["a"] * 60, [*["a", "b"] * 40], ["a"] * 45 + make(20), base[0], [], None, ["a", "b"]]
    table = spark.createDataFrame([(k, d and " ".join(d), b"", "y") for k, d in enumerate(docs)], "id long, text string, class binary, key string")
    made = ch.rendered_fingerprints(table, ["id"], "text")
    asked = ch.rendered_fingerprints(table.filter("id % 3 = 0 OR id >= 100"), ["id"], "text", excerpts=noise)
    rows = [(r.id, r.match.id, r) for r in ch.align(made, asked, ["id"]).collect()]
    rows = [type("Row", (), r.asDict() | {"__getitem__": lambda self, k, x=(a, b): x[k]})() for a, b, r in rows]
    want, found = check(rows, prints_of(asked, "id"), prints_of(made, "id"))
    assert len(want) > 60 and (0, 0) in found
    assert {r.members for r in rows if r[1] == 0} == {2}
    assert ch.align(made.limit(0), asked, ["id"]).count() == ch.align(made, asked.limit(0), ["id"]).count() == 0
    same = ch.fingerprints(ch.render(table, ["id"], "text"), ["id"])  # the sound as a table of its own
    assert {k: v.tobytes() for k, v in prints_of(same, "id").items()} == {k: v.tobytes() for k, v in prints_of(made, "id").items()}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.match_conv_id, r.match_turn, r) for r in QUERIES["op3_chroma_fingerprints"](spark, sf).collect()]
    rows = [type("Row", (), r.asDict() | {"__getitem__": lambda self, k, x=((a, b), (c, d)): x[k]})() for a, b, c, d, r in rows]
    turns, ids = spark.read.parquet(f"{sf}/conversations.parquet"), ["conv_id", "turn"]
    made, asked = ch.rendered_fingerprints(turns, ids, "text"), ch.rendered_fingerprints(turns.filter("conv_id % 20 = 0"), ids, "text", excerpts=True)
    assert {r[0][0] % 20 for r in rows} == {0} and len({r[0] for r in rows}) > 12
    some = {k: v for k, v in prints_of(asked, *ids).items() if k[0] % 100 == 0}  # all pairs of a fifth of the queries
    want, found = check([r for r in rows if r[0] in some], some, prints_of(made, *ids))
    assert len(want) > 1 and {k for k in want if k[0] == k[1]}


@pytest.mark.parametrize("text", ["a " * 30_000, " ".join(str(k) for k in range(20_000))])
def test_long(spark, text):
    docs = spark.createDataFrame([(0, text), (1, text + "b"), (None, text), (None, text)], "id long, text string")
    made = ch.rendered_fingerprints(docs, ["id"], "text")
    got = ch.align(made, made.filter("id IS NULL OR id = 1"), ["id"]).collect()
    assert {(r.id, r.match.id, r.members) for r in got} == {(q, m, n) for q in (None, 1) for m, n in ((None, 3), (1, 1))}
    assert sum(r.id is None and r.match.id == 1 for r in got) == 2 * sum(r.id == 1 and r.match.id is None for r in got)


def test_every_place_of_a_repeated_phrase(spark):
    """A phrase that a recording has five times matches at all five, and one note held long within other sound matches, whatever its hash."""
    rng = np.random.default_rng(3)
    make = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    phrase = make(40)
    docs = {0: [*make(7), *(w for k in range(5) for w in [*phrase, *make(9 + k)])], 1: phrase}
    docs |= {10 + 2 * k + j: [*make(30), *[f"n{k}"] * 40, *make(30)] for k in range(12) for j in (0, 1)}
    table = spark.createDataFrame([(k, " ".join(d)) for k, d in docs.items()], "id long, text string")
    made = ch.rendered_fingerprints(table, ["id"], "text")
    got = {}
    for r in ch.align(made, made.filter("id = 1 OR id >= 10 AND id % 2 = 0"), ["id"]).collect():
        got.setdefault((r.id, r.match.id), set()).add(r.offset)
    assert {2 * (7 + 40 * k + sum(range(9, 9 + k))) for k in range(5)} <= got[1, 0]
    assert all((10 + 2 * k, 11 + 2 * k) in got for k in range(12))


def test_offsets_and_matches():
    """Offsets by a transform are those of all pairs; offsets that are not compared would not be chosen."""
    rng = np.random.default_rng(5)
    a, b = np.sort(rng.choice(3000, 700, False)), np.sort(rng.choice(900, 400, False))
    want = np.unique(np.subtract.outer(a, b), return_counts=True)
    assert all(np.array_equal(x, y) for x, y in zip(want, ch.offsets(a, b), strict=True))
    bar = rng.integers(0, 1 << 32, 5, np.uint32)
    one, two = (np.tile(bar, n) ^ (rng.random(5 * n) < 0.1).astype(np.uint32) for n in (40, 60))
    tried = np.arange(-len(one), len(two))
    found = sorted((-n, wrong, int(o), start) for o in tried for start, n, wrong in [ch.stretch(one, two, int(o))] if n >= ch.LEAST_FRAMES)
    chosen = []
    for n, wrong, o, start in found:
        if all(abs(o - c[0]) >= ch.WIDTH for c in chosen):
            chosen.append((o, 1, start, -n, wrong / (-32 * n)))
    assert ch.matches(one, two, tried, np.ones(len(tried), np.int64)) == chosen and len(chosen) > 5
