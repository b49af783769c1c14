"""Encoding, decoding and packing against the libraries themselves."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, packing
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "  a", "a  ", "\n\n a\tb\n", "x\x1cy \x1c z", "don't I'LL  we've", "é̂ ñ 日本語 　 x", "👩‍👩‍👧 🏳️‍🌈!!", "１２３ ²³ Ⅷ", "ſt  q   z\u0085",
    "<|endoftext|> a<|startoftext|>", "A.B,c;D!?e'S. É, é., x1,2 a.'s b,'t", "J\u030c T\u0308, W\u030ax. I\u0307", "İstanbul ΣΑΣ ς", "word " * 3000, "x" * 5000, "\r\n\r\n  \t'S 's",
]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_is_the_tiktoken_encoding(exact):
    made = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in filter(None, ODD):
        ids = np.frombuffer(made.encode(text), "<u4").tolist()
        assert ids == exact.encode_ordinary(text), text
        assert "".join(made.decode_parts(ids)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stlé1!　")), max_size=60))
def test_codec_on_any_text(text):
    made = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ranks = {t: r for r, t in made.token.items()}
    own = _ENCODING.setdefault("own", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert np.frombuffer(made.encode(text), "<u4").tolist() == own.encode_ordinary(text)


_ENCODING: dict = {}


def test_round_trip_query(spark, exact):
    rows = QUERIES["op6_byte_bpe"](spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        ids = exact.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_encode_then_decode_tables(spark):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(ODD)], "doc_id long, text string, ids int, id string")
    encoded = byte_bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.text).decode() for r in byte_bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}
    for r in encoded.collect():
        assert len(r.ids) == len(r.starts) and r.starts == sorted(r.starts)
    assert byte_bpe.bpe_round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


PLAIN = Tokenizer.from_file(WORDS)


def _brute(text, model):
    return [*model.encode(text or "", add_special_tokens=False).ids, 0]


SPECIAL = ["<|endoftext|>", "so<|startoftext|><|endoftext|>it", "A <|ENDOFTEXT|> b <|endoftext |>", "e<|endoftext|>\u0301 don<|endoftext|>'t", "x%%% y.'s é!! <|startoftext|>."]


def test_words_one_by_one_are_the_whole_text():
    model = Tokenizer.from_file(WORDS)
    made = packing.WordTokenizer(WORDS)
    for text in [*filter(None, ODD), *SPECIAL]:
        assert np.frombuffer(made.encode(text.encode()), "<u4").tolist() == _brute(text, model)[:-1], text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*" \n'stlé1!.,;Jj\u030c\u0308", "<|endoftext|>"])), max_size=60).map("".join))
def test_words_of_any_text(text):
    made = packing.word_tokenizer(WORDS)
    assert np.frombuffer(made.encode(text.encode()), "<u4").tolist() == _brute(text, PLAIN)[:-1]


def _check_packing(rows, text, model):
    whole, bins = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(whole) == set(text)
    for k, pieces in whole.items():
        ids = np.array(_brute(text[k], model), "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(math.ceil(len(ids) / 2048)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 2048 and r.length == min(2048, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(x.length for x in rows)


def test_packing_query(spark):
    model = Tokenizer.from_file(WORDS)
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, tokens = _check_packing(rows, text, model)
    assert n <= math.ceil(tokens / 2048) * 1.02 + 1


def test_packing_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, *SPECIAL] * 20)], "doc_id long, text string")
    model = Tokenizer.from_file(WORDS)
    _check_packing(packing.pack_documents(docs, WORDS).collect(), dict(enumerate([*ODD, *SPECIAL] * 20)), model)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_swaps_empty_a_bin():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # best fit by size alone needs a fourth bin of 10
    assert len(packing.pack(sizes, 10)) == 3
    assert packing.pack([], 10) == []
    assert sorted(k for b in packing.pack([10, 1, 10], 10) for k in b) == [0, 1, 2]
