"""Text features: sources, counts, item lists, hashed encodings, pooled chunks, scores by base decile."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.primitives import global_rank
from plumbline.functions.skew import skewed_join

from .ranking import auc, average_ranks, correlation, pr_auc


def source_text(cols: Sequence[str], max_chars: int) -> Column:
    """The columns joined by a space, null as empty, trimmed and cut."""
    return F.substring(F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 1, max_chars)


def text_presence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df with c_present: 1 where there is text but white space."""
    return df.withColumns({f"{c}_present": F.coalesce((F.length(F.trim(F.col(c))) > 0).cast("int"), F.lit(0)) for c in cols})


def masked_score(score: str, present: str) -> Column:
    return F.when(F.col(present) == 1, F.col(score))


def text_stats(df: DataFrame, col: str, keywords: Sequence[str] = ()) -> DataFrame:
    """df with length, words, mean word length, punctuation, digits and keyword counts; null counts as empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^ \t-\r]+"))
    letters = F.length(F.regexp_replace(text, r"[ \t-\r]+", ""))
    out = {"length": F.length(text), "words": words, "mean_word": F.coalesce(letters / F.nullif(words, F.lit(0)), F.lit(0.0)), "punctuation": F.regexp_count(text, F.lit("[.,;:!?]")), "digits": F.regexp_count(text, F.lit("[0-9]"))}
    out |= {f"kw_{k}": F.regexp_count(F.lower(text), F.lit(k)) for k in keywords}
    return df.withColumns({f"{col}_{name}": c for name, c in out.items()})


def list_items(text: Column, separators: str = r"[\^,;|]") -> Column:
    return F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x != "")


def item_weights(df: DataFrame, text: str) -> DataFrame:
    """item, df, idf = ln((1 + N) / (1 + df)) + 1 over rows with items."""
    rows = df.select(F.array_distinct(list_items(F.col(text))).alias("i")).filter(F.size("i") > 0)
    n = rows.agg(F.count("*").alias("n"))
    items = rows.select(F.explode("i").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    return items.crossJoin(F.broadcast(n)).select("item", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def list_aggregate(df: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """key, mean, total, weighted: of the items' values (item, value), plain and weighted by idf."""
    items = df.select(key, F.explode(list_items(F.col(text))).alias("item"))
    rows = skewed_join(items, values.join(item_weights(df, text), "item"), ["item"])
    weighted = F.sum(F.col("value") * F.col("idf")) / F.nullif(F.sum("idf"), F.lit(0.0))
    return rows.groupBy(key).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), weighted.alias("weighted"))


def _crc_table() -> np.ndarray:
    """The CRC32 steps of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def hash_vector(texts: pd.Series, dim: int) -> np.ndarray:
    """Character 1- and 2-grams hashed into dim places by the CRC32 of their UTF-8 bytes, rows of length 1.

    All grams of all texts are hashed together: those of a length in bytes a byte at a time.
    """
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    ends = np.cumsum([len(t) for t in encoded], dtype=np.int64)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
    owner = np.searchsorted(ends, starts, "right")
    stops = np.append(starts[1:], len(data))
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(starts) else starts
    begin, end, row = (np.concatenate(x) for x in ((starts, starts[pair]), (stops, stops[pair + 1] if len(pair) else stops[:0]), (owner, owner[pair])))
    crc, size = np.full(len(begin), 0xFFFFFFFF, np.uint32), end - begin
    for k in range(int(size.max(initial=0))):
        on = size > k
        crc[on] = _CRC[(crc[on] ^ data[begin[on] + k]) & 0xFF] ^ (crc[on] >> np.uint32(8))
    place = (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(dim)
    out = np.bincount(row * dim + place, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode_distinct(df: DataFrame, text: str, fn: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    """df with vector: each distinct text (null as empty) is encoded once and joined back."""
    value = F.coalesce(F.col(text), F.lit(""))

    @F.pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(s)))

    made = df.select(value.alias("__t")).distinct().withColumn("vector", encode("__t"))
    return skewed_join(df.withColumn("__t", value), made, ["__t"]).drop("__t")


def hash_encode(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    return encode_distinct(df, text, lambda s: hash_vector(s, dim))


def chunk_pool(df: DataFrame, key: str, text: str, max_chars: int, fn: Callable[[pd.Series], np.ndarray], dim: int) -> DataFrame:
    """key, chunks, vector: the mean vector of the text's windows of max_chars; zeros for empty text."""
    n = F.greatest(F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / max_chars), F.lit(1)).cast("int")
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("__i"))
    rows = rows.select(key, F.substring(F.col("__t"), F.col("__i") * max_chars + 1, F.lit(max_chars)).alias("__c"))
    vectors = encode_distinct(rows, "__c", fn)
    mean = lambda k: F.avg(F.when(F.length("__c") > 0, F.col("vector")[k]).otherwise(0.0))
    return vectors.groupBy(key).agg(F.count("*").alias("chunks"), F.array(*[mean(k) for k in range(dim)]).alias("vector"))


def feature_metrics_by_split(long: DataFrame, label: str) -> DataFrame:
    """split, feature, auc, pr_auc of each column as a score."""
    keys = ["split", "feature"]
    return auc(long, label, "value", keys).join(pr_auc(long, label, "value", keys), keys)


def conditional_auc(df: DataFrame, feature: str, base: str, label: str, key: str, n: int = 10) -> DataFrame:
    """decile of the base score, rows, auc of the feature inside it."""
    rows = global_rank(df.filter(F.col(base).isNotNull()), [base, key])
    total = rows.agg(F.count("*").alias("__n"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("decile", F.floor(F.col("rank") * n / F.col("__n")))  # one row
    return rows.groupBy("decile").agg(F.count("*").alias("rows")).join(auc(rows, label, feature, ["decile"]), "decile", "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns over rows where neither is null."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit("x").alias("feature"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranks = average_ranks(average_ranks(rows, ["feature"], "__a").withColumnRenamed("rank", "__ra"), ["feature"], "__b")
    return ranks.agg(correlation("__ra", "rank").alias("spearman"))
