"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import text_bytes, written

MIN_BYTES, MEAN_BITS, MAX_BYTES = 512, 11, 16384
_WINDOW = 16
#: Text that the rolling hash is computed over at a time.
SLICE_BYTES = 2 << 20

CHUNKS = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType())]))


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that end at each position, for the whole buffer at once."""
    h = (np.arange(256, dtype=np.uint32) * np.uint32(2654435761) ^ np.uint32(0x9E3779B9))[data]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    step = 1
    while step < _WINDOW:  # h over 2 * step bytes from two over step bytes
        if len(h) > step:
            h[step:] = h[step:] + h[:-step] * np.uint32(pow(31, step, 1 << 32))
        step *= 2
    return h


def cut_points(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]: the first cut after MIN_BYTES, or MAX_BYTES."""
    ends = []
    while end - start > MIN_BYTES:
        k = np.searchsorted(cuts, start + MIN_BYTES)
        start = min(int(cuts[k]) if k < len(cuts) else end, start + MAX_BYTES, end)
        ends.append(start)
    return ends if ends and ends[-1] == end else [*ends, end]


def _recipes(data: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
    """Chunks and whole digest of each text between the offsets; the rolling hash covers SLICE_BYTES or one text at a time."""
    view, recipes, whole, first = memoryview(data), [], [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        base = int(offsets[first])
        cuts = np.flatnonzero(rolling_hash(data[base : offsets[last]]) >> np.uint32(32 - MEAN_BITS) == 0) + (base + 1)
        for start, end in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True):
            recipe, at = [], start
            for cut in cut_points(cuts, start, end):
                part = view[at:cut]
                recipe.append({"hash": xxhash.xxh64_intdigest(part) - (1 << 63), "n": cut - at, "digest": hashlib.sha256(part).digest()})
                at = cut
            recipes.append(recipe)
            whole.append(recipe[0]["digest"].hex() if len(recipe) == 1 else hashlib.sha256(view[start:end]).hexdigest())
        first = last
    return recipes, whole


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())]))
    for batch in batches:
        recipes, whole = _recipes(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(recipes, kind), pa.array(whole, pa.string())], ["id", "chunks", "text_sha256"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, chunks, text_sha256 of each row, written once; the texts are read once and not moved."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("chunks", CHUNKS), T.StructField("text_sha256", T.StringType())])
    made = rows.mapInArrow(_chunked, schema).withColumn("row", F.monotonically_increasing_id())
    return written(made, "recipes")


def identifiers(rows: DataFrame) -> DataFrame:
    """rows with recipe: the digest of the ordered list of verified chunk identifiers.

    An identifier is (hash, length, variant). The variant numbers the contents
    that share hash and length; while all chunks of each hash and length have
    one digest, as they nearly always do, it is 0 and nothing is joined.
    """
    parts = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).select("row", "at", "chunk.*")
    told = F.xxhash64("digest")
    clashes = written(parts.groupBy("hash", "n").agg(F.min(told).alias("a"), F.max(told).alias("z")).filter("a <> z").select("hash", "n"), "clashes")
    if clashes.isEmpty():
        listed = rows.withColumn("ids", F.transform("chunks", lambda x: F.struct(x["hash"], x["n"], F.lit(0).alias("variant"))))
    else:
        several = parts.join(clashes, ["hash", "n"]).select("hash", "n", "digest").distinct()
        nth = F.row_number().over(Window.partitionBy("hash", "n").orderBy("digest")).cast("int")
        variants = several.select("hash", "n", "digest", nth.alias("variant"))
        known = parts.join(variants, ["hash", "n", "digest"], "left").select("row", "at", "hash", "n", F.coalesce("variant", F.lit(0)).alias("variant"))
        lists = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "n", "variant"))).alias("ids"))
        listed = rows.join(lists, "row")
    line = F.array_join(F.transform("ids", lambda x: F.concat_ws(":", x["hash"], x["n"], x["variant"])), ",")
    return listed.withColumn("recipe", F.unhex(F.sha2(line, 256)))


#: Parts that the copies of one text are dealt over.
SALTS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of identical texts, one result row per input row.

    Texts are cut at content-defined points. Chunks that share a 64-bit hash
    and a length are told apart by their SHA-256, so a chunk's identifier
    (hash, length, variant) is verified; documents with the same ordered list
    of identifiers are copies. Only hashes and digests are shuffled. Copies of
    one text are summed up and told their group in SALTS parts.

    Null texts count as empty, and empty texts are copies of each other. Of
    copies, the row with the largest id stays (nulls count as smallest; of rows
    repeated with one id, one stays). An empty table gives an empty result;
    other columns are ignored, whatever their names.

    Returns id_col, keep_id, group_size, kept, text_sha256.
    """
    rows = chunk_recipes(docs, id_col, text_col)
    told = identifiers(rows).select("row", "id", "text_sha256", "recipe", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = told.groupBy("recipe", "salt").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"))
    spread = parts.select("recipe", "salt").join(groups, "recipe")
    return told.join(spread, ["recipe", "salt"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one that exact_dedup keeps; all columns as they are.

    Where each id stands for one row, rows are dropped by their ids and whole
    documents are shuffled once at most. Where an id repeats, rows are told
    apart by id and text; of those equal in both, the row whose columns come
    last as JSON stays.
    """
    told = written(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "kept", F.col("text_sha256").alias("__sha")), "told")
    if told.groupBy("__id").count().filter("count > 1").isEmpty():
        gone = told.filter("NOT kept").select("__id")
        return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")
    kept = told.filter("kept").select("__id", "__sha")
    rows = docs.withColumn("__digest", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["__id"]) & (rows["__digest"] == kept["__sha"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col, "__digest").orderBy(F.to_json(F.struct(*docs.columns)).desc()))
    return rows.withColumn("__nth", nth).filter("__nth = 1").select(docs.columns)
