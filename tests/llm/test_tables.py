"""Language identification, token rollups and URL filters."""

import base64
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import language_id as li
from plumbline.llm.queries import QUERIES, TOKENIZERS
from plumbline.llm.token_counts import Rollup, deltas, document_counts
from plumbline.llm.url_filters import filter_captures


def test_letters(spark):
    """Number-like signs are no letters; one letter is enough."""
    docs = [(k, f"the quick {k} brown fox and the dog" if k % 2 else f"der schnelle {k} braune Fuchs und ein Hund", "en" if k % 2 else "de") for k in range(60)]
    docs += [(100, "½ ²", None), (101, "Ⅷ ① ²", None), (102, "", None), (103, None, None), (104, "12 , _ 7", None), (105, "the 1", None)]
    got = {r.doc_id: r.lang_pred for r in li.language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert {k: got[k] for k in range(100, 106)} == {**{k: "und" for k in range(100, 105)}, 105: "en"}


def test_many_languages(spark):
    """All languages are learned, more of them than embedding sizes or than 256."""
    docs = [(k, " ".join(f"q{k % 300:03d}{j}" for j in range(k % 7, k % 7 + 5)), f"l{k % 300}") for k in range(2400)]
    model = li.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and not model.direct and model.rows.shape == (1 << li.BUCKET_BITS, li.SIZE)
    assert model.predict(docs[0][1])[0] in model.languages


def test_rare_languages_keep_their_quota(spark):
    """Ten languages of 3,000 documents and one of 360: each has its quota, the rare one all."""
    docs = spark.range(30_360).selectExpr("xxhash64(id) AS hash", "concat('word', id) AS text", "concat('l', least(id DIV 3000, 10)) AS lang")
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    got = {r.lang: r["count"] for r in li.sampled(docs, counts).groupBy("lang").count().collect()}
    assert counts["l10"] == 360 and got == {f"l{k}": 360 if k == 10 else 4000 // 11 for k in range(11)}


def test_fit_is_plain_descent():
    """The fitted model's scores are those of the same sums over whole texts, bucket by bucket."""
    texts = [("the cat and the dog", 0), ("le chat et le chien", 1)] * 10
    samples = [(*(lambda b, n: (b, (n / n.sum()).astype("<f4")))(*np.unique(li.subwords(t), return_counts=True)), k) for t, k in texts]
    model = li.fit(samples, ["en", "fr"], samples[:4])
    for text, k in texts[:2]:
        buckets = li.subwords(text)
        mean = sum(model.table[b].astype(float) for b in buckets) / len(buckets)
        scores = np.exp((x := mean @ model.layer / model.temperature) - x.max())
        want = scores / scores.sum()
        lang, score = model.predict(text)
        assert lang == ["en", "fr"][k] == ["en", "fr"][int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-5)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.985
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = [(k, "the cat and the dog are here " * 3, "en") for k in range(60)] + [(100 + k, "le chat et le chien sont là " * 3, "fr") for k in range(60)]
    docs += [(300, None, "en"), (301, "", "fr"), (302, "12 !! 34", "en"), (303, "the dog", None), (None, "le chien", "fr"), (304, "the cat " * 50_000, None), (305, "日本語", None)]
    table = spark.createDataFrame([(*d, "s", 0.5) for d in docs], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in li.language_id(table).collect()}
    for k in (300, 301, 302):
        assert got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected
    assert got[303].lang_pred == "en" and got[None].lang_pred == "fr" and got[304].lang_pred == "en" and got[305].lang_pred in ("en", "fr")
    assert not got[None].held_out
    assert li.language_id(table.limit(0)).count() == 0
    assert {r.lang_pred for r in li.language_id(table.withColumn("lang", table["lang"].substr(9, 1)).filter("lang is null")).collect()} == {"und"}


FILES = {v: public_tokenizers.path(n) for v, n in TOKENIZERS.items()}


def tokens(version):
    """The number of tokens of a text, by each library as it comes."""
    with open(FILES["byte_bpe_multi_50k"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = Tokenizer.from_file(FILES["word_bpe_49k"])
    return {
        "byte_bpe_multi_50k": lambda text: len(encoding.encode_ordinary(text or "")),
        "word_bpe_49k": lambda text: len(model.encode(text or "", add_special_tokens=False).ids),
    }[version]


def test_token_count_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels.setdefault(r.doc_id, []).append(r)
    want = Counter()
    of = {v: tokens(v) for v in TOKENIZERS}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = labels.get(r.doc_id, [])
        if max([x.toxic for x in own if x.toxic is not None], default=0) == 1:
            continue
        poor = min([x.quality for x in own if x.quality is not None], default=1) == 0
        for v in TOKENIZERS:
            want[r.source, r.lang, v, "docs"] += 1
            want[r.source, r.lang, v, "tokens"] += of[v](re.sub("[0-9]+", "", r.text or "") if poor else r.text)
    got = QUERIES["op1_token_counts"](spark, sf).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {k[:3]: (n, want[*k[:3], "tokens"]) for k, n in want.items() if k[3] == "docs"}


def test_rollup_batches(spark, tmp_path):
    long = "naïve 12 " * 30_000
    rows = [(1, "a b 1", "s", "en"), (2, None, "s", "en"), (3, "x-y", None, None), (3, "x-y", None, None), (None, "", "", "en"), (5, long, "t", "fr")]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, source string, lang string, n int, tokenizer string")
    counts = document_counts(docs, FILES, public_tokenizers.PATTERN)
    of = {v: tokens(v) for v in FILES}
    assert Counter(tuple(r) for r in counts.collect()) == Counter((k, s, x, v, of[v](t), of[v](t)) for k, t, s, x in rows for v in FILES)
    rollup = Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    assert rollup.commit("one", deltas(counts, F.col("n"), 1))
    first = {tuple(r) for r in rollup.totals().collect()}
    want = Counter()
    for _, t, s, x in rows:
        for v in FILES:
            want[s, x, v] += of[v](t)
    assert {(*x[:3], x[4]) for x in first} == {(*k, n) for k, n in want.items()}
    assert {x[3] for x in first if x[0] is None} == {2} and {x[3] for x in first if x[0] == "s"} == {2}
    assert not rollup.commit("one", deltas(counts, F.col("n"), 1))  # sent again, as after a lost driver
    with pytest.raises(ValueError, match="other content"):
        rollup.commit("one", deltas(counts.limit(1), F.col("n"), 1))
    assert {tuple(r) for r in rollup.totals().collect()} == first and rollup.committed() == ["one"]
    (tmp_path / "rollup" / ".aside-1").mkdir()  # of a writer that was lost before its commit
    third = counts.filter("doc_id = 3")
    assert rollup.commit("lost", deltas(third, F.col("n"), -1).unionByName(deltas(counts.limit(0), F.col("n"), 1)))
    assert {tuple(r) for r in rollup.totals().collect()} == {x for x in first if x[0] is not None}
    assert rollup.commit("empty", deltas(counts.limit(0), F.col("n"), 1)) and rollup.committed() == ["empty", "lost", "one"]
    assert rollup.commit("longer", deltas(third, F.lit(5), 1, documents=False))  # a revision by its difference
    assert {(r.n_docs, r.n_tokens) for r in rollup.totals().filter("source IS NULL").collect()} == {(0, 10)}
    assert sorted(p.name for p in (tmp_path / "rollup").glob("v=*")) == ["v=2", "v=3", "v=4"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits while this one has read the totals; both batches count."""
    rows = spark.createDataFrame([("s", "en", "t", 1, 10)], "source string, lang string, tokenizer string, docs long, tokens long")
    one, two = Rollup(spark, f"file://{tmp_path}/rollup"), Rollup(spark, f"file://{tmp_path}/rollup")
    renamed, calls = Rollup._renamed, []

    def late(self, source, target):
        if self is one and not calls:
            calls.append(two.commit("two", rows))
        return renamed(self, source, target)

    monkeypatch.setattr(Rollup, "_renamed", late)
    assert one.commit("one", rows) and calls == [True]
    assert one.committed() == ["one", "two"] and [tuple(r) for r in one.totals().collect()] == [("s", "en", "t", 2, 20)]


def test_url_lists_as_of(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    entries = [
        ("bad", "block", "example.com", "add", day(10)), ("bad", "block", "example.com", "remove", day(20)), ("bad", "block", "example.com", "add", day(30)),
        ("good", "allow", "ok.example.com", "add", day(5)), ("bad", "block", "x.org", "add", day(1)), ("bad", "block", "x.org", "remove", day(1)),
        ("bad", "block", None, "add", day(1)), (None, "block", "y.org", "add", day(1)), ("bad", "block", "y.org", "add", None),
    ]
    captures = [
        (1, "http://a.example.com/x", day(9)), (2, "http://a.example.com", day(10)), (3, "https://u:p@A.Example.com:80?q", day(20)), (4, "http://example.com", day(31)), (5, "http://ok.example.com/", day(15)),
        (6, None, day(15)), (7, "no url", day(15)), (8, "http://x.org", day(2)), (9, "http://y.org", day(2)), (10, "http://example.com", None), (11, "http://com", day(15)), (4, "http://example.com", day(31)),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, at timestamp")
    c = spark.createDataFrame([(*x, "h", "l") for x in captures], "page_id long, url string, fetched timestamp, host string, list string")
    got = {r.page_id: (r.decision, r.lists) for r in filter_captures(c, e).collect()}
    assert got == {1: ("keep", ""), 2: ("block", "bad"), 3: ("keep", ""), 4: ("block", "bad"), 5: ("allow", "bad,good"), **{k: ("keep", "") for k in (6, 7, 8, 9, 10, 11)}}
    assert filter_captures(c.limit(0), e).count() == 0
    assert {r.decision for r in filter_captures(c, e.limit(0)).collect()} == {"keep"}


def test_hosts_and_repeated_captures(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    e = spark.createDataFrame([("bad", "block", k, "add", day(0)) for k in ("x.com", "[2001:db8::1]", "10.0.0.7", "0.7")], "list string, kind string, key string, action string, at timestamp")
    urls = ["http://x.com./a", "//x.com/", "  https://x.com", "http://a@b@x.com", "http://[2001:DB8::1]:80/", "http://10.0.0.7:8", "http://9.9.0.7", "http://u:p@10.0.0.7", "mailto:x.com", "http://", "http://x.com"]
    c = spark.createDataFrame([(k, u, day(1)) for k, u in enumerate(urls)] + [(10, urls[10], day(1))], "page_id long, url string, fetched timestamp")
    got = {r.page_id: r for r in filter_captures(c, e).collect()}
    assert {k for k, r in got.items() if r.decision == "block"} == {0, 1, 2, 3, 4, 5, 7, 10}
    assert got[4].host == "[2001:db8::1]" and got[0].host == "x.com" and got[8].host is None and got[9].host is None
    assert got[10].n_active == 1 and len(got) == len(urls)
