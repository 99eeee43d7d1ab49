"""Language identification with a byte-level convolutional network, trained in numpy.

A window of bytes goes through an embedding, filters of several widths, a rectifier, max
pooling over the window and a softmax. The whole text is cut into windows of fixed length;
the mean of their log probabilities, weighted by their bytes, decides. For prediction the
embedding and the filters are multiplied out into tables of byte pairs, so that a filter of
width 4 costs two look-ups a byte.

The fit takes a bounded sample of the labelled rows: `sample_docs` of each language, two
windows of each. Predictions cover every row and every byte.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .rows import id_type
from .workers import claim

#: Bytes of a window, size of the embedding, filter widths and filters of each.
LENGTH = 192
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled documents of each language that a fit takes at most, and windows of each.
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 2
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclasses.dataclass
class Net:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width * EMBEDDING, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, one after the other; the last one is filled up with zeros."""
    n = max(1, -(-len(text) // LENGTH))
    return np.frombuffer(text.ljust(n * LENGTH, b"\0"), np.uint8).reshape(n, LENGTH)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of windows x with languages y, and its gradient by every parameter."""
    n = len(x)
    e = p["e"][x]
    pooled, places = [], []
    for w in WIDTHS:
        span = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - w + 1, w * EMBEDDING)
        h = span @ p[f"w{w}"]
        at = h.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(h, at[:, None], 1)[:, 0] + p[f"b{w}"])
    a = np.concatenate(pooled, axis=1)
    r = np.maximum(a, 0)
    z = _log_softmax(r @ p["v"] + p["c"])
    d = np.exp(z)
    d[np.arange(n), y] -= 1
    d /= n
    g = {"v": r.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
    da = (d @ p["v"].T) * (a > 0)
    for k, w in enumerate(WIDTHS):
        dk, at = da[:, k * FILTERS : (k + 1) * FILTERS], places[k]
        took = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # (n, filters, w)
        g[f"w{w}"] = np.einsum("nf,nfi->if", dk, p["e"][took].reshape(n, FILTERS, w * EMBEDDING))
        g[f"b{w}"] = dk.sum(axis=0)
        back = dk[:, :, None, None] * p[f"w{w}"].T.reshape(FILTERS, w, EMBEDDING)
        np.add.at(g["e"], took.ravel(), back.reshape(-1, EMBEDDING))
    return -float(z[np.arange(n), y].mean()), g


def train(x: np.ndarray, y: np.ndarray, languages: list[str], *, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Fits by Adam on cross entropy. x: windows (n, LENGTH); y: numbers of languages."""
    rng = np.random.default_rng(seed)
    classes = len(languages)
    p: dict[str, np.ndarray] = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "v": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            own = order[s : s + batch]
            # Some windows are cut short, as the last one of a text is.
            cut = np.where(rng.random(len(own)) < 0.3, rng.integers(12, LENGTH, len(own)), LENGTH)
            _, g = gradients(p, np.where(np.arange(LENGTH) < cut[:, None], x[own], 0), y[own])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = p[k].astype(np.float32)
    return Net(languages, p["e"], {w: p[f"w{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["v"], p["c"])


class Predictor:
    """A network with its filters multiplied out into tables of bytes and byte pairs."""

    def __init__(self, net: Net):
        self.net = net
        self.tables: list[tuple[int, list[tuple[int, bool, np.ndarray]]]] = []
        for w in WIDTHS:
            one = [net.embedding @ part for part in net.filters[w].reshape(w, EMBEDDING, FILTERS)]
            pairs = [(k, True, (one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS).astype(np.float32)) for k in range(0, w - 1, 2)]
            self.tables.append((w, pairs + ([(w - 1, False, one[w - 1].astype(np.float32))] if w % 2 else [])))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages)."""
        single = x.astype(np.int32)
        pair = single[:, :-1] << 8 | single[:, 1:]
        pooled = []
        for w, parts in self.tables:
            size, h = LENGTH - w + 1, None
            for k, double, table in parts:
                got = table.take((pair if double else single)[:, k : k + size], axis=0)
                h = got if h is None else np.add(h, got, out=h)
            pooled.append(h.max(axis=1) + self.net.bias[w])
        return _log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.out + self.net.out_bias)

    def predict(self, texts: list[str | None], chunk: int = 1024) -> list[tuple[str, float]]:
        """(language, probability) of each text; und and 0 without any letter."""
        raw = [t.encode("utf-8", "surrogatepass") if t and LETTER.search(t) else b"" for t in texts]
        n = np.array([max(1, -(-len(r) // LENGTH)) for r in raw], np.int64)
        total = np.zeros((len(texts), len(self.net.languages)))
        owner, held, size = np.repeat(np.arange(len(raw)), n), [], 0

        def flush(first: int) -> None:
            x = np.concatenate(held)
            weight = np.count_nonzero(x, axis=1)[:, None]
            for k in range(0, len(x), chunk):
                part = slice(first + k, first + min(k + chunk, len(x)))
                np.add.at(total, owner[part], self.log_probabilities(x[k : k + chunk]) * weight[k : k + chunk])

        first = 0
        for r in raw:
            held.append(windows(r))
            size += len(held[-1])
            if size >= 4 * chunk:
                flush(first)
                first, size, held = first + size, 0, []
        if held:
            flush(first)
        mean = total / np.array([max(1, np.count_nonzero(np.frombuffer(r, np.uint8))) for r in raw])[:, None]
        p = np.exp(_log_softmax(mean)) if len(mean) else mean
        best = p.argmax(axis=1) if len(p) else []
        return [(self.net.languages[b], float(p[k, b])) if raw[k] else (UNDETERMINED, 0.0) for k, b in enumerate(best)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Net | None:
    """A network from the rows whose language isn't null; None if there are no such texts.

    A hash of id and text picks about `sample_docs` different rows of each language, by a share
    that follows from the language's count; rows that are the same in both count once. What
    comes back to the driver is SAMPLE_WINDOWS windows of each.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, sample_docs / counts[lang])]), F.col("lang"))
    b, n = F.encode("text", "utf-8"), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(LENGTH)).cast("int"))
    picked = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share).select("lang", F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda k: F.substring(b, F.pmod(F.xxhash64("h", k), n).cast("int") * LENGTH + 1, F.lit(LENGTH))).alias("w"), "h").groupBy("lang", "h").agg(F.min("w").alias("w"))
    sample = sorted((r.lang, bytes(w)) for r in picked.collect() for w in r.w)
    if len(languages) == 1:
        sample.append((languages[0], b""))
    x = np.concatenate([windows(w)[:1] for _, w in sample])
    y = np.array([languages.index(lang) for lang, _ in sample])
    return train(x, y, languages)


def identify(docs: DataFrame, net: Net | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score for each row, from its whole text.

    und with score 0: null texts, texts without any letter, and every text if there was
    nothing to learn from. Repeated rows get a result each; ids are of any type; other columns
    are ignored.
    """
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        own = Predictor(net) if net else None
        for b in batches:
            got = [(UNDETERMINED, 0.0)] * b.num_rows
            if own:
                got = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=out)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {name}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Predictions for docs with held_out; only rows with held_out false teach."""
    out = held_out(F.col(id_col), 4, 2)
    net = fit(docs.where(~out), id_col=id_col, text_col=text_col, lang_col=lang_col, sample_docs=sample_docs)
    return identify(docs, net, id_col=id_col, text_col=text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
