"""Aligned tokens of two tokenizers against whole texts, the merge of runs against a counter."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumbline.llm import cross_tokens as ct
from plumbline.llm.byte_bpe import byte_characters
from plumbline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.byte = {c: k for k, c in enumerate(byte_characters())}

    def bytes_b(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[-1] == ">" else p.replace("▁", " ").encode()

    def align(self, text):
        """ids of A and B by group, links; nothing where bytes differ."""
        if not text:
            return [], []
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in t) for t in ids_a.tokens]
        bytes_b = [self.bytes_b(k) for k in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], []
        spans = lambda ids, parts: [(k, int(e) - len(p), int(e)) for k, p, e in zip(ids, parts, np.cumsum([len(p) for p in parts]))]
        span_a, span_b = spans(ids_a.ids, bytes_a), spans(ids_b, bytes_b)
        both = sorted({e for *_, e in span_a} & {e for *_, e in span_b})
        groups, last, i, j = [], 0, 0, 0
        for e in both:
            one, two = [], []
            while i < len(span_a) and span_a[i][2] <= e:
                one.append(span_a[i][0])
                i += 1
            while j < len(span_b) and span_b[j][2] <= e:
                two.append(span_b[j][0])
                j += 1
            groups.append((one, two))
        links, j = [], 0
        for x, s, e in span_a:
            while j and span_b[j][1] >= s:
                j -= 1
            while j < len(span_b) and span_b[j][1] < e:
                if span_b[j][2] > s:
                    links.append((x, span_b[j][0]))
                j += 1
            j = min(j, len(span_b) - 1)
        return groups, links


def expected(rows):
    plain = Plain()
    made = [plain.align(text) for _, text in rows]
    count = Counter(p for _, links in made for p in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    for (key, _), (groups, links) in zip(rows, made):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_cross_tokens"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


ODD = ["a", "Z", "é", "é", "ß", "1", "²", ".", ",", "'s", " ", "  ", "   ", "\n", "\n\n", "\t", "\r", ";\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "日本", "🙂", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\x00", "the", " The", "ing", "▁"]


def test_odd_texts(spark, monkeypatch):
    """Every kind of space and mark, texts that don't come back, null and empty ones, repeated rows, a long text; several blocks."""
    monkeypatch.setattr(ct, "BLOCK_PARTS", 500)
    made = random.Random(5)
    rows = [(k, "".join(made.choices(ODD[:-1] if k % 9 else ODD, k=made.randrange(1, 16)))) for k in range(1500)]
    rows += [(2000, None), (2001, ""), (None, "no id"), (2003, "same text"), (2003, "same text"), (2004, "long text of words " * 20_000), (2005, " "), (2006, "\n"), (2007, "x" * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, radix int, run string").repartition(3)
    got = sorted(map(tuple, ct.cross_tokens(docs, A, B).collect()), key=str)
    assert got == sorted(expected(rows), key=str)
    assert 20 < sum(r[1] == 0 for r in got) < 500
    assert ct.cross_tokens(docs.limit(0), A, B).count() == 0
    assert sorted(map(tuple, ct.cross_tokens(docs.filter("doc_id in (2000, 2001)"), A, B).collect())) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (2000, 2001)]


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_merge_levels(spark, monkeypatch, fan):
    """Answers of runs that are merged over several levels, in chunks of a few pairs, equal a counter's."""
    monkeypatch.setattr(ct, "CHUNK_PAIRS", 7)
    rng = np.random.default_rng(fan)
    rows, runs, count = [], {}, Counter()
    for node in range(13):
        for radix in (0, 1):
            keys = np.unique(rng.integers(0, 6, 60) * 2 + radix << 32 | rng.integers(0, 20, 60))
            counts = rng.integers(1, 5, len(keys))
            runs[node, radix] = keys
            for k, n in zip(keys.tolist(), counts.tolist()):
                count[k] += n
            rows.append((node, radix, 10 * node, bytearray(ct.write_run([(keys, counts)]))))
    highest = {b: max(n for k, n in count.items() if k >> 32 == b) for b in {k >> 32 for k in count}}
    table = spark.createDataFrame(rows, "node long, radix int, first long, run binary")
    got = ct.count_pairs(table, 13, fan).collect()
    assert sorted((r.node, r.radix, r["first"]) for r in got) == sorted((n, x, 10 * n) for n, x in runs)
    for r in got:
        keys = runs[r.node, r.radix].tolist()
        _, counts, best = ct._answered(bytes(r.answer), False)
        assert counts.tolist() == [count[k] for k in keys]
        assert best.tolist() == [count[k] == highest[k >> 32] for k in keys]


def test_merge_in_order(monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_PAIRS", 5)
    rng = np.random.default_rng(1)
    runs, count = [], Counter()
    for size in (0, 1, 4, 5, 6, 40, 200, 200):
        keys = np.unique(rng.integers(0, 300, size) << 30)
        runs.append(ct.write_run([(keys, np.ones(len(keys), np.int64))]))
        count.update(keys.tolist())
    chunks = list(ct.merge_runs(runs))
    assert len(chunks) > 5 and np.concatenate([k for k, _ in chunks]).tolist() == sorted(count)
    assert np.concatenate([n for _, n in chunks]).tolist() == [count[k] for k in sorted(count)]
    assert list(ct.merge_runs([])) == []
