"""Quality classifier by compression with zstandard dictionaries.

One dictionary is trained on good labelled text and one on bad. A text is cut into blocks, and
each block is compressed on its own with either: what the dictionaries know weighs more than
what a long text says of itself. The sums over all blocks of the whole text give the
difference (bad - good) of the compressed sizes, normalised by the bytes of the text: how much
better the good dictionary knows it, a byte. A text that repeats itself has next to none. A rising step curve, fitted on
labelled texts that the dictionaries haven't seen with the classes weighted as they are in the labels, turns the
difference into a calibrated score. The difference is the curve's only input; a text of few
bytes tells little, so its score is drawn to the labels' share as if PULL bytes had said so.

The fit takes a bounded sample of the labelled rows: `sample_docs` of each class, half for the
dictionaries and half for the calibration. Scores cover every row.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import id_type
from .workers import claim

#: Bytes that are compressed at once, size of a dictionary, level of compression.
BLOCK = 256
DICTIONARY = 64 * 1024
LEVEL = 3
#: Labelled documents of each class that a fit takes at most, and blocks of each that go into a dictionary.
SAMPLE_DOCS = 3000
SAMPLE_BLOCKS = 8
#: Bytes that say as much as the labels' share of good texts.
PULL = 64


@dataclasses.dataclass(frozen=True)
class Model:
    """Both dictionaries, the share of label 1, and the curve: differences and their scores, both ascending."""

    good: bytes
    bad: bytes
    prior: float
    at: tuple[float, ...] = ()
    scores: tuple[float, ...] = ()

    @property
    def ready(self) -> bool:
        return bool(self.at)


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, model: Model):
        self.coders = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, int]:
        """(difference for each byte, bytes); zeros for an empty text."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0
        good = bad = 0
        a, b = (c.compress for c in self.coders)
        for k in range(0, len(raw), BLOCK):
            part = raw[k : k + BLOCK]
            good += len(a(part))
            bad += len(b(part))
        return (bad - good) / len(raw), len(raw)


def scores(model: Model, features: np.ndarray) -> np.ndarray:
    """Calibrated probability of label 1; an empty text has the labels' share."""
    if not model.ready:
        return np.full(len(features), model.prior)
    size = features[:, 1]
    return (np.interp(features[:, 0], model.at, model.scores) * size + model.prior * PULL) / (size + PULL)


def _dictionary(samples: list[bytes]) -> bytes:
    samples = sorted(s for s in samples if s)
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(samples)[-DICTIONARY:].rjust(8, b" ")


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps (mean x, mean y) of the rising curve of least weighted squares: neighbours in x that fall are pooled. Each step's mean is drawn to one half by one more row."""
    steps: list[list[float]] = []
    for k in np.argsort(x, kind="stable").tolist():
        w = float(weight[k])
        steps.append([float(x[k]) * w, float(y[k]) * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    s = np.array(steps)
    return s[:, 0] / s[:, 2], np.maximum.accumulate((s[:, 1] + 0.5) / (s[:, 2] + 1))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from labels (id_col, label_col of 0 or 1) of docs.

    Ids labelled both ways are left out; of the rows of one id the one with the smallest hash of
    its text is learned from. Without labels of both classes there are no
    dictionaries: every text then gets the (smoothed) share of label 1.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
    own = own.where("label = most").select(F.col(id_col).alias("id"), "label", F.xxhash64(F.col(id_col), F.lit(17)).alias("h"))
    count = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    none = Model(b"", b"", (n1 + 1) / (n0 + n1 + 2))
    if not (n0 and n1):
        return none
    picked = own.where("label = 0").orderBy("h", "id").limit(sample_docs).union(own.where("label = 1").orderBy("h", "id").limit(sample_docs))
    # At most 2 * sample_docs ids are broadcast, and SAMPLE_BLOCKS blocks of each come back.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "label", "x.text")
    teach = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0
    raw = rows.where(teach).select("id", "label", F.encode("text", "utf-8").alias("b"))
    blocks = raw.select("id", "label", F.explode(F.slice(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("b") / F.lit(BLOCK)).cast("int") - 1)),
        lambda i: F.struct(F.xxhash64(F.col("id"), i).alias("h"), F.substring(F.col("b"), i * BLOCK + 1, F.lit(BLOCK)).alias("block")))), 1, SAMPLE_BLOCKS)).alias("x"))
    sample = blocks.select("label", "x.block").collect()
    good, bad = (_dictionary([bytes(r.block) for r in sample if r.label == y]) for y in (1, 0))
    model = Model(good, bad, none.prior)

    schema = pa.schema([("label", pa.int32()), ("d", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        sizes = Sizes(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sizes.features(t)[0] for t in b.column(1).to_pylist()], pa.float64())], schema=schema)

    seen = rows.where(~teach & (F.col("text") != "")).select("label", "text").mapInArrow(measure, "label int, d double").toPandas().sort_values(["d", "label"])
    y = seen["label"].to_numpy(float)
    if len(set(y)) < 2:
        return none
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum())) * len(y) / (n0 + n1)
    at, values = rising(seen["d"].to_numpy(), y, weight)
    return dataclasses.replace(model, at=tuple(at.tolist()), scores=tuple(values.tolist()))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) of each row.

    Every row is scored by its whole text, block after block; a null text counts as empty and
    has the labels' share of label 1. Other columns are ignored; rows of the same id are scored each by its own text. An empty table gives no rows.
    """
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        sizes = Sizes(model) if model.ready else None
        for b in batches:
            texts = b.column(1).to_pylist()
            f = np.array([sizes.features(t) if sizes else (0.0, 0) for t in texts]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, f))], schema=out)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {name}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """True for ids whose crc32 (of the id as text) modulo folds is fold; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """id_col, held_out, score and predicted of each row, as `score` gives them; the model learns from the labels of the other rows only.

    Labels that are null, neither 0 nor 1, of both kinds for an id, or without an id are left out.
    """
    model = fit(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, sample_docs=sample_docs)
    got = score(docs, model, id_col=id_col, text_col=text_col)
    return got.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs that aren't predicted bad, with all their columns. Scored and filtered where they are read: no text is shuffled.

    Null and empty texts have the labels' share of label 1 as their score, and stay if that is one half or more. Rows of
    one id stay or go each by its own text; texts of any length are scored whole; columns of any name are kept. An empty table stays empty.
    """
    model = fit(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, sample_docs=sample_docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        sizes = Sizes(model) if model.ready else None
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            f = np.array([sizes.features(t) if sizes else (0.0, 0) for t in texts]).reshape(-1, 2)
            yield b.filter(pa.array(scores(model, f) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
