"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import base64
import functools
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import word_tokenizer
from .tables import texts

KEYS = ("source", "lang", "tokenizer")
#: Totals that stay readable beside the newest, for readers that have just begun.
KEPT_VERSIONS = 2


@functools.lru_cache(maxsize=2)
def _ranked(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str) -> Callable[[list[bytes]], list[int]]:
    """Numbers of tokens of UTF-8 texts: by ranks (.tiktoken), or by a tokenizer that drops white space (.json)."""
    if path.endswith(".tiktoken"):
        encoding = _ranked(path, pattern)
        return lambda several: [len(encoding.encode_ordinary(t.decode())) for t in several]
    if path.endswith(".json"):
        return lambda several: [len(ids) // 4 for ids in word_tokenizer(path).encode_all(several)]
    raise ValueError(f"no counter for {path}")


def document_counts(docs: DataFrame, tokenizers: dict[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text", revised: Column | None = None) -> DataFrame:
    """id_col, source, lang, tokenizer, n, revised: tokens of each whole text and of a revision of it, for every tokenizer version.

    tokenizers: the file of each version. revised is null where nothing was
    revised, and so means n there. A null text has no tokens. Repeated rows and
    null ids are rows like others; other columns are ignored. The texts are
    read once and not moved.
    """
    new = F.lit(None) if revised is None else revised
    rows = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string").alias("text"), new.cast("string").alias("revised"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {version: counter(path, pattern) for version, path in tokenizers.items()}
        for batch in batches:
            known = batch.column("revised").is_valid()
            asked, whole = texts(batch.column("revised").filter(known)), texts(batch.column("text"))
            own = [batch.column(c) for c in ("id", "source", "lang")]
            for version, of in count.items():
                told = iter(of(asked))
                after = [next(told) if x else None for x in known.to_pylist()]
                yield pa.RecordBatch.from_arrays([*own, pa.array([version] * len(whole), pa.string()), pa.array(of(whole), pa.int64()), pa.array(after, pa.int64())], ["id", "source", "lang", "tokenizer", "n", "revised"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, source string, lang string, tokenizer string, n long, revised long")
    return made.withColumn("revised", F.coalesce("revised", "n")).withColumnRenamed("id", id_col)


def deltas(counts: DataFrame, tokens: Column, sign: int, documents: bool = True) -> DataFrame:
    """Signed counts: sign 1 inserts, -1 deletes. A revision is the old count deleted and the new one inserted, or the difference with no documents."""
    return counts.select(*KEYS, F.lit(sign * documents).cast("long").alias("docs"), (tokens * sign).alias("tokens"))


class Rollup:
    """Additive totals under path, one row for each source, language and tokenizer version.

    path/v=N holds the totals after N commits, and the batches that are in them
    with a digest of each. A commit adds a batch's summed deltas to the newest
    totals, writes that aside and renames it to v=N+1. The rename is the commit:
    it fails if another writer was there first, and then the commit starts
    anew from that writer's totals. So no batch is lost or counted twice, and a
    writer that is lost before its rename has done nothing. A batch that is
    committed again changes nothing; if its content differs it is refused.

    A read costs the newest totals, however many batches there were. Needs a
    file system whose rename is atomic. A null source or language is a key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Of the newest totals; 0 before the first commit."""
        if not self._fs.exists(self._at(self.path)):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        return max([0, *(int(n[2:]) for n in names if n.startswith("v="))])

    def _state(self, version: int) -> tuple[DataFrame, dict[str, str]]:
        if not version:
            empty = ", ".join([*(f"{k} string" for k in KEYS), "docs long", "tokens long"])
            return self.spark.createDataFrame([], empty), {}
        batches = {r.batch: r.digest for r in self.spark.read.schema("batch string, digest string").json(f"{self.path}/v={version}/batches").collect()}  # a row for each batch
        return self.spark.read.parquet(f"{self.path}/v={version}/totals"), batches

    def committed(self) -> list[str]:
        return sorted(self._state(self.version())[1])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch's signed deltas (KEYS, docs, tokens) once; False if it was committed before."""
        changes = self._summed(changes)
        told = changes.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEYS, "docs", "tokens").cast("decimal(38,0)"))).first()
        digest = f"{told[0]}:{told[1]}"
        while True:
            now = self.version()
            totals, batches = self._state(now)
            if batch in batches:
                if batches[batch] != digest:
                    raise ValueError(f"batch {batch} was committed with other content")
                return False
            aside = f"{self.path}/.aside-{uuid.uuid4().hex}"
            self._summed(totals.unionByName(changes)).filter("docs <> 0 OR tokens <> 0").coalesce(1).write.parquet(f"{aside}/totals")
            self._put(f"{aside}/batches/list.json", "\n".join(json.dumps({"batch": b, "digest": d}) for b, d in sorted((batches | {batch: digest}).items())))
            if self._renamed(aside, f"{self.path}/v={now + 1}"):
                self._fs.delete(self._at(f"{self.path}/v={now - KEPT_VERSIONS}"), True)
                return True
            self._fs.delete(self._at(aside), True)

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._at(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _renamed(self, source: str, target: str) -> bool:
        """False if target is there already, from another writer's commit."""
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._at(source), self._at(target), options)
        except Exception:
            if self._fs.exists(self._at(target)):
                return False
            raise
        return True

    @staticmethod
    def _summed(changes: DataFrame) -> DataFrame:
        return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of keys that still have documents or tokens."""
        return self._state(self.version())[0].select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))
