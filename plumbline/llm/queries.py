"""The opN queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma
from .byte_bpe import bpe_round_trip
from .cross_tokens import cross_tokens
from .exact_dedup import exact_dedup
from .katz import katz_scores
from .language_id import language_id
from .packing import pack_documents
from .periodic import periodic_runs, with_planted_run
from .simhash import simhash_dedup
from .substring_dedup import repeated_passages
from .tables import discard, shared_folder, table, written
from .token_counts import Rollup, deltas, document_counts
from .url_filters import filter_captures, host_of, suffixes
from .wavelet import read_documents, write_shards


#: Tokenizer versions and their files.
TOKENIZERS = {"byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken", "word_bpe_49k": "word_bpe_49k.json"}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, revises those of quality 0 (digits go), then deletes the toxic ones; every batch comes twice."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    revised = F.when(text.rlike("[0-9]"), F.regexp_replace(text, "[0-9]+", ""))
    files = {version: public_tokenizers.path(name) for version, name in TOKENIZERS.items()}
    counts = written(document_counts(docs, files, public_tokenizers.PATTERN, revised=revised), "counts")
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 0).alias("poor"), (F.max("toxic") == 1).alias("toxic"))
    marked = counts.join(flags, "doc_id")
    n, new = F.col("n"), F.col("revised")
    poor, toxic = marked.filter("poor"), marked.filter("toxic")
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.commit("load", deltas(counts, n, 1))
        rollup.commit("revise", deltas(poor, n, -1).unionByName(deltas(poor, new, 1)))
        rollup.commit("moderate", deltas(toxic, F.when(F.col("poor"), new).otherwise(n), -1))
    discard(counts)
    return rollup.totals()


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as recordings; of every turn of a conversation whose id is divisible by 20, a noisy excerpt is searched among all."""
    turns = table(spark, sf_dir, "conversations")
    ids = ["conv_id", "turn"]
    prints = chroma.rendered_fingerprints(turns, ids, "text")
    queries = chroma.rendered_fingerprints(turns.filter(F.col("conv_id") % 20 == 0), ids, "text", excerpts=True)
    found = chroma.align(prints, queries, ids)
    return found.select("*", F.col("match.conv_id").alias("match_conv_id"), F.col("match.turn").alias("match_turn")).drop("match")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def _part(key: str, at: int) -> F.Column:
    """A number below 2 ** 24 that is fixed for each key."""
    return F.conv(F.substring(F.md5(F.col(key)), at, 6), 16, 10).cast("long")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as captured at a time of 2024, under lists whose entries for its hosts and domains come and go in that year."""
    second = lambda days: F.timestamp_seconds(F.lit(1704067200) + days * 86400)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 31536000))
    keys = captures.select(F.explode(suffixes(host_of(F.col("url")))).alias("s")).select("s.key").filter("key is not null").distinct()
    one, two = _part("key", 1), _part("key", 7)
    entry = lambda name, kind, action, days: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.lit(action).alias("action"), second(days).alias("at"))
    entries = F.array(
        entry("spam", "block", "add", one % 200), entry("spam", "block", "remove", one % 200 + two % 60 + 1), entry("spam", "block", "add", one % 200 + two % 60 + 40),
        entry("trusted", "allow", "add", two % 300), entry("trusted", "allow", "remove", two % 300 + 50),
        entry("malware", "block", "add", one * 3 % 365),
    )
    wanted = {"spam": one % 3 == 0, "trusted": two % 4 == 1, "malware": one % 7 == 2}
    rows = keys.select("key", F.explode(entries).alias("e"), one.alias("one")).select("key", "e.*")
    keep = F.lit(False)
    for name, which in wanted.items():
        keep = keep | ((F.col("list") == name) & which)
    return filter_captures(captures, rows.filter(keep))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op11_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2), "token-files")
    return read_documents(files)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in all documents, a tenth of which get repeated stretches."""
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", with_planted_run(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    found = periodic_runs(planted).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_katz_scores": op10_katz_scores,
    "op11_wavelet_shards": op11_wavelet_shards,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_cross_tokens": op13_cross_tokens,
}

SQL = {
    "op5_url_filters": r"""
        WITH captures AS (
            SELECT page_id, TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919) % 31536000) AS fetched,
                   nullif(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '[.\s]+$', ''), '') AS host FROM pages),
        keys AS (
            SELECT page_id, fetched, host, array_to_string(list_slice(labels, i, len(labels)), '.') AS key, len(labels) - i + 1 AS depth
            FROM (SELECT *, CASE WHEN regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') THEN [host] ELSE string_split(host, '.') END AS labels FROM captures) AS x
            LEFT JOIN LATERAL (SELECT unnest(range(1, greatest(len(x.labels), 2))) AS i) AS y ON true),
        hashed AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS one, ('0x' || substr(md5(key), 7, 6))::BIGINT AS two FROM keys WHERE key IS NOT NULL),
        entries AS (
            SELECT 'spam' AS list, key, 'add' AS action, one % 200 AS day FROM hashed WHERE one % 3 = 0
            UNION ALL SELECT 'spam', key, 'remove', one % 200 + two % 60 + 1 FROM hashed WHERE one % 3 = 0
            UNION ALL SELECT 'spam', key, 'add', one % 200 + two % 60 + 40 FROM hashed WHERE one % 3 = 0
            UNION ALL SELECT 'trusted', key, 'add', two % 300 FROM hashed WHERE two % 4 = 1
            UNION ALL SELECT 'trusted', key, 'remove', two % 300 + 50 FROM hashed WHERE two % 4 = 1
            UNION ALL SELECT 'malware', key, 'add', one * 3 % 365 FROM hashed WHERE one % 7 = 2),
        spans AS (
            SELECT list, key, action, TIMESTAMP '2024-01-01' + to_days(day::INT) AS valid_from,
                   lead(TIMESTAMP '2024-01-01' + to_days(day::INT)) OVER (PARTITION BY list, key ORDER BY day) AS valid_to
            FROM entries),
        met AS (
            SELECT k.page_id, k.fetched, k.host, s.list, s.key, k.depth * 2 + (s.list = 'trusted')::INT AS weight
            FROM keys k LEFT JOIN spans s ON k.key = s.key AND s.action = 'add' AND s.valid_from <= k.fetched AND (s.valid_to IS NULL OR k.fetched < s.valid_to))
        SELECT page_id, fetched, host, count(DISTINCT list || ' ' || key) AS n_active, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists,
               CASE WHEN max(weight) IS NULL THEN 'keep' WHEN max(weight) % 2 = 1 THEN 'allow' ELSE 'block' END AS decision
        FROM met GROUP BY page_id, fetched, host
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
