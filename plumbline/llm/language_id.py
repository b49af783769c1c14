"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled documents that the model is fitted on, in all, whole texts; as many of each language, one at least.
SAMPLE_DOCS = 4_000
BUCKET_BITS, SIZE, EPOCHS, RATE = 16, 16, 6, 0.5
ORDERS = (2, 3, 4)
#: Of the calibration documents, the share that the rejection threshold may refuse, and the highest threshold.
REJECT_SHARE, REJECT_BELOW = 0.001, 0.6
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_CLEAN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def subwords(text: str) -> np.ndarray:
    """Buckets of the byte n-grams within words, each word with a space at both ends."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letters = _CLEAN[data].astype(np.uint32)
    space, found = letters == 32, []
    for n in ORDERS:
        m = len(letters) - n + 1
        if m <= 0:
            continue
        mixed = np.full(m, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ letters[k : m + k]) * np.uint32(16777619)
        keep = ~(space[:m] & space[n - 1 :])
        for k in range(1, n - 1):
            keep &= ~space[k : m + k]
        found.append((mixed[keep] * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """table: the embedding of each bucket; layer: from the mean embedding of a text to a score for each language."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self) -> None:
        # of few languages, each bucket's scores are kept instead of its embedding
        self.direct = len(self.languages) <= SIZE
        self.rows = self.table @ self.layer if self.direct else self.table

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(buckets), 1 << 18):
            total += self.rows[buckets[at : at + (1 << 18)]].sum(0, dtype=np.float64)
        total /= max(len(buckets), 1)
        return total if self.direct else total @ self.layer

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(subwords(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], calibration: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """samples: (buckets, their shares, language number) of each text. The calibration texts set the temperature and the threshold."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BUCKET_BITS, SIZE)).astype(np.float32)
    layer = rng.normal(0, 0.1, (SIZE, len(languages))).astype(np.float32)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            buckets, share, language = samples[k]
            rate = RATE * (1 - step / steps)
            step += 1
            vector = share @ table[buckets]
            gap = softmax(vector @ layer)
            gap[language] -= 1
            back = layer @ gap
            layer -= rate * np.outer(vector, gap)
            table[buckets] -= (rate * share)[:, None] * back * 20  # a bucket sees only its share of the texts
    model = Model(languages, table, layer, 1.0, 0.0)
    if calibration:
        logits = np.array([share @ table[buckets] @ layer for buckets, share, _ in calibration])
        truth = np.array([y for *_, y in calibration])
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 4, 40)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        right = p.max(1)[p.argmax(1) == truth]
        model.threshold = float(min(REJECT_BELOW, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return model


def remainder(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: of it, and of a short and a middling excerpt, the distinct buckets and their shares."""
    part = pa.struct([("whole", pa.bool_()), ("buckets", pa.binary()), ("share", pa.binary())])
    for batch in batches:
        out = []
        for text, h in zip(batch.column("text").to_pylist(), batch.column("hash").to_pylist(), strict=True):
            at, parts = h % max(len(text), 1), []
            for piece in (text, text[at : at + 60], text[at // 2 : at // 2 + 300]):
                buckets, n = np.unique(subwords(piece), return_counts=True)
                if len(buckets):
                    parts.append({"whole": not parts, "buckets": buckets.astype("<u4").tobytes(), "share": (n / n.sum()).astype("<f4").tobytes()})
            out.append(parts)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(out, pa.list_(part))], ["lang", "hash", "parts"])


FITTED = "table binary, layer binary, temperature double, threshold double"


def _fit_all(languages: list[str]):
    """Fits on the rows of _features, a fifth of them for calibration; one row with the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        learn, check = [], []
        for batch in batches:
            for lang, h, parts in zip(*(batch.column(c).to_pylist() for c in ("lang", "hash", "parts")), strict=True):
                for p in parts:
                    if h % 5 or p["whole"]:
                        (learn if h % 5 else check).append((np.frombuffer(p["buckets"], "<u4"), np.frombuffer(p["share"], "<f4"), number[lang]))
        model = fit(learn or check, languages, check)
        row = {"table": model.table.astype("<f4").tobytes(), "layer": model.layer.astype("<f4").tobytes(), "temperature": model.temperature, "threshold": model.threshold}
        yield pa.RecordBatch.from_pylist([row])

    return run


def sampled(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """lang, hash, parts (features) of the chosen rows: of each language those with the smallest hashes, as many as its quota.

    A share of each language that is nearly sure to hold its quota is taken
    before features are made, so that little is ordered.
    """
    quota = max(1, SAMPLE_DOCS // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (quota + 4 * quota**0.5 + 16) / n))])
    near = rows.withColumn("hash", F.pmod("hash", F.lit(1 << 40))).filter(F.col("hash") < share[F.col("lang")] * F.lit(1 << 40))
    made = near.mapInArrow(_features, "lang string, hash long, parts array<struct<whole: boolean, buckets: binary, share: binary>>")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # of little more than the quota
    return made.withColumn("place", place).filter(F.col("place") <= quota).drop("place")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of labelled documents: of each language all, or SAMPLE_DOCS by the number of languages, by a hash of the id.

    Features of whole texts are made where the rows are; one task fits, on
    SAMPLE_DOCS rows of at most 2 ** BUCKET_BITS buckets each, and only the
    model comes to the driver. With more languages than SAMPLE_DOCS the sample is
    one document of each.
    """
    rows = labelled.select(F.xxhash64(id_col).alias("hash"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, SIZE), np.float32), np.zeros((SIZE, 0), np.float32), 1.0, 0.0)
    got = sampled(rows, counts).orderBy("hash", "lang").coalesce(1).mapInArrow(_fit_all(languages), FITTED).first()
    shaped = lambda data, n: np.frombuffer(bytes(data), "<f4").reshape(n, -1)
    return Model(languages, shaped(got["table"], 1 << BUCKET_BITS), shaped(got["layer"], SIZE), got["temperature"], got["threshold"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (0 to 1, calibrated), rejected of every whole text, from the text alone.

    A null text, or one without letters, is `und` with score 0 and rejected;
    others are rejected below the model's threshold. Equal texts get equal
    results; repeated rows are kept; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t) for t in batch.column("text").to_pylist()]
            langs, scores = [x for x, _ in made], [y for _, y in made]
            rejected = [x == UNKNOWN or y < model.threshold for x, y in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learns from documents outside the held-out fold (crc32 of the id as text, modulo folds) and predicts all.

    A document with a null id is in no fold: it is predicted, not learned from.
    Without labelled documents all predictions are `und`. Returns id_col,
    held_out, lang_pred, score, rejected.
    """
    model = train(docs.filter(remainder(id_col, folds) != held_out), id_col, text_col, lang_col)
    made = identify(docs, model, id_col, text_col)
    return made.select(id_col, F.coalesce(remainder(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([x != UNKNOWN and y >= model.threshold for x, y in made], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
