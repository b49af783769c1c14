"""Token files: the wavelet matrix against plain arrays, the query against the tokenizer over all texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import wavelet
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
NONE = pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64())})


@pytest.mark.parametrize("n, most", [(0, 5), (1, 5), (7, 1), (65_536, 300), (65_537, 300), (200_000, 40_000), (70_000, 100_000)])
def test_lookups(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    if n > 100:
        ids[: n // 3] = 1
    file = wavelet.WaveletFile(wavelet.write_file(ids, 17, NONE))
    assert np.array_equal(file.ids(), ids)
    for at in {0, n // 2, n - 1, 65_535, 65_536} & set(range(n)):
        assert file.access(at) == ids[at]
    for token in (0, 1, most - 1, most, 1 << 20):
        where = np.flatnonzero(ids == token)
        assert file.count(token) == len(where) and np.array_equal(file.occurrences(token), where)
        assert np.array_equal(file.occurrences(token, 2, 3), where[2:5])
        a, b = n // 5, n - n // 7
        assert file.count(token, a, b) == ((where >= a) & (where < b)).sum()
    with pytest.raises(IndexError):
        file.access(n)


def test_id_over_the_planes():
    with pytest.raises(ValueError):
        wavelet.write_file(np.array([4], np.uint32), 2, NONE)


def reference(rows):
    """In rising order of id, null first: start, n, crc32, by the tokenizer over whole texts."""
    model, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op11_wavelet_shards"](spark, sf).collect())) == reference(rows)


def odd_texts():
    made = random.Random(3)
    pool = ["a", "Z", "é", "ß", "ɏ", "ɐ", "1", "²", ".", ",", "'s", "'", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "​", "日本", "🙂", "é", "×", "÷", "<|endoftext|>", "<|", "|>", "\x00", "the", " The"]
    return ["".join(made.choices(pool, k=made.randrange(1, 14))) for _ in range(3000)]


def test_parts_give_the_tokens_of_the_text():
    texts, model, encoder = odd_texts(), Tokenizer.from_file(PATH), wavelet.PartEncoder(PATH)
    ids, starts = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_rows(spark, monkeypatch):
    """Null and empty texts, null ids, negative ids, repeated rows, one id with many texts, documents over several files, other columns."""
    monkeypatch.setattr(wavelet, "SHARD_IDS", 1000)
    monkeypatch.setattr(wavelet, "ROW_IDS", 300)
    rows = [(5, None), (7, ""), (None, "no id"), (-3, "x " * 5000), (9, "long " * 20_000), (11, "same"), (11, "same"), *[(8, f"text {k} of one id") for k in range(200)]]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, bucket string, shard int, file string")
    files = wavelet.write_shards(docs.repartition(7), PATH, 2).cache()
    got = sorted(wavelet.read_documents(files).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == [None, -3, 5, 7, *[8] * 200, 9, 11, 11]
    by_crc = {(k, n, crc) for k, _, n, crc in reference(rows)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == by_crc
    assert max(r.n for r in files.collect()) <= 1000
    ids = [t for r in got for t in reference_ids(rows, r)]
    where = [k for k, t in enumerate(ids) if t == 2]
    assert sorted(r.position for r in wavelet.token_places(files, 2).collect()) == where
    assert {r.token: r["count"] for r in wavelet.token_counts(files, [2, 890, 49_999]).collect()} == {2: len(where), 890: ids.count(890), 49_999: 0}
    asked = spark.createDataFrame([(0,), (5,), (len(ids) - 1,), (len(ids),), (None,), (5,)], "position long")
    assert sorted(map(tuple, wavelet.tokens_at(files, asked).collect()), key=str) == sorted([(0, ids[0]), (5, ids[5]), (5, ids[5]), (len(ids) - 1, 2), (len(ids), None), (None, None)], key=str)
    files.unpersist()


def reference_ids(rows, found):
    model = Tokenizer.from_file(PATH)
    for key, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        if key == found.doc_id and zlib.crc32(np.array(ids, "<u4").tobytes()) == found.ids_crc32:
            return ids
    raise AssertionError(found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.read_documents(wavelet.write_shards(docs, PATH, 2)).withColumn("one", F.lit(1)).count() == 0
