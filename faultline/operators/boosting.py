"""Boosted trees on histograms, for all folds at once, and what is stored of them.

Features are cut once into bins, a byte for each. Every task sums up gradients of its rows for
each model, node, feature and bin; these histograms are added up by a shuffle, in blocks of
features, and each block names its best split. The driver gets a row for each block and node, and
grows the trees by a level. Gradients are whole numbers in the smallest unit that their sum
allows, so a sum doesn't depend on the order of rows, and a task that runs again gives the same.

A model's rounds end when its own fold, from which it hasn't learned, has had no smaller loss for
`patience` rounds; the rounds up to the smallest loss are kept. Margins are written every few
rounds; with a `state` folder, so are the trees, and a run that was broken off goes on from there.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.ingest import exists, fingerprint
from faultline.sources.scratch import materialize, release

from .evaluate import best_threshold
from .joins import require
from .reports import model_problems

#: Features of a block of histograms.
BLOCK = 32
#: A split must gain more than this.
LEAST_GAIN = 1e-9


@dataclasses.dataclass(frozen=True)
class Params:
    """The defaults are fixed values, but for the depth: trees grow by levels, to as many leaves as 63 at least."""

    rounds: int = 700
    rate: float = 0.03
    depth: int = 6
    leaf: int = 50
    l1: float = 0.1
    l2: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 100
    bins: int = 64
    seed: int = 42
    keep: int = 10


@dataclasses.dataclass
class Tree:
    """Node i has the children 2 i + 1 and 2 i + 2; a row goes left if its bin is at most `cut`. A feature of -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of bins."""
        flat, rows = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        feature, leaf = np.maximum(self.feature, 0).astype(np.int64), self.feature < 0
        cut = np.where(leaf, 256, self.cut)  # what is at a leaf goes nowhere
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            down = 2 * at + 1 + (flat[rows + feature[at]] > cut[at])
            at = np.where(leaf[at], at, down) if leaf.any() else down
        return at


@dataclasses.dataclass
class FoldModels:
    """A model for each fold: `trees[k]` has never seen fold k, but for the number of its rounds."""

    features: tuple[str, ...]
    edges: list[list[float]]
    trees: list[list[Tree]]
    losses: list[list[float]]
    meta: dict

    def margins(self, bins: np.ndarray, k: int) -> np.ndarray:
        """Log odds of rows of bins by model k."""
        out = np.zeros(len(bins))
        for t in self.trees[k]:
            out += t.value[t.nodes(bins)]
        return out

    def importances(self) -> list[tuple[str, float]]:
        """Mean number of splits of a model by each feature, largest first."""
        used = np.zeros(len(self.features))
        for trees in self.trees:
            for t in trees:
                used += np.bincount(t.feature[t.feature >= 0], minlength=len(used))
        mean = used / max(1, len(self.trees))
        return sorted(zip(self.features, mean.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 64) -> list[list[float]]:
    """At most bins - 2 ascending edges for each feature: quantiles, from sketches of bounded size. Nulls and NaN have a bin of their own."""
    at = F.array(*[F.lit((k + 1) / (bins - 1)) for k in range(bins - 2)])
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    got = rows.agg(*[F.percentile_approx(x, at, F.lit(1000)).alias(c) for c, x in clean.items()]).first()
    return [sorted(set(got[c] or [])) for c in features]


def binned(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of a table of doubles: 0 without a value, else 1 + the number of edges below it."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(edges):
        x = values[:, k]
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left"))
    return out


def _values(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Columns from `first` on as doubles, NaN for null."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[first:]], axis=1) if batch.num_columns > first else np.empty((batch.num_rows, 0))


def _packed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of binaries of `width` numbers each, as a table over the column's own memory."""
    n, size = len(column), width * np.dtype(kind).itemsize
    if not n * size:
        return np.empty((n, width), kind)
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    if column.null_count or (np.diff(at) != size).any():
        raise ValueError(f"binaries of {size} bytes are expected")
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(n, width)


def _doubles(features: Sequence[str]) -> list:
    return [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]


def sampled(key: np.ndarray, seed: int, turn: int, model: int, share: float) -> np.ndarray:
    """Which rows (by their 64-bit key) a round of a model learns from."""
    salt = int(np.random.default_rng([seed, turn, model]).integers(0, 2**63))
    h = key.astype(np.uint64) ^ np.uint64(salt)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(m)
    return (h >> np.uint64(11)).astype(float) / 2**53 < share


def chosen(features: int, seed: int, turn: int, model: int, share: float) -> np.ndarray:
    """Which features a round of a model may split by."""
    n = max(1, math.ceil(share * features))
    mask = np.zeros(features, bool)
    mask[np.random.default_rng([seed, turn, model, 1]).permutation(features)[:n]] = True
    return mask


def leaf_value(g: float, h: float, p: Params) -> float:
    return -p.rate * math.copysign(max(0.0, abs(g) - p.l1), g) / (h + p.l2)


def gains(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Gain of a cut after each bin (last axis) but the last, from sums of gradients, second derivatives and rows; minus infinity where a side has too few rows."""
    score = lambda a, b: np.maximum(0.0, np.abs(a) - p.l1) ** 2 / (b + p.l2)
    gl, hl, nl = (np.cumsum(x, axis=-1)[..., :-1] for x in (g, h, n))
    ga, ha, na = (x.sum(axis=-1, keepdims=True) for x in (g, h, n))
    got = score(gl, hl) + score(ga - gl, ha - hl) - score(ga, ha)
    return np.where((nl >= p.leaf) & (na - nl >= p.leaf), got, -np.inf)


def gradients(margin: np.ndarray, y: np.ndarray, weights: tuple[float, float], unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted gradients and second derivatives of the log loss, in whole units."""
    prob = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, weights[1], weights[0])
    return np.rint(w * (prob - y) * unit), np.rint(w * prob * (1 - prob) * unit)


def log_loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(y == 1, -margin, margin))


class _Training:
    """Binned rows with their margins in all models, as written last, and the trees grown since."""

    def __init__(self, rows: DataFrame, features: Sequence[str], edges: list[list[float]], label: str, fold: str, folds: int, key: str, p: Params) -> None:
        self.p, self.folds, self.width, self.edges = p, folds, len(features), edges
        out = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("fold", pa.int32()), ("bins", pa.binary()), ("margins", pa.binary())])
        zeros = np.zeros(folds).tobytes()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = binned(_values(b, 3), edges)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([zeros] * len(x), pa.binary())], schema=out)

        chosen_ = rows.select(F.xxhash64(key).alias("key"), F.coalesce(F.col(label), F.lit(0)).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), *_doubles(features))
        self.rows = materialize(chosen_.mapInArrow(cut, "key long, y int, fold int, bins binary, margins binary"))
        counts = self.rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
        self.n = sum(r.n for r in counts)
        self.weights, self.valid = [], [0] * folds
        for k in range(folds):
            n, pos = sum(r.n for r in counts if r.fold != k), sum(r.pos for r in counts if r.fold != k)
            self.weights.append((n / (2 * max(1, n - pos)), n / (2 * max(1, pos))))
            self.valid[k] = sum(r.n for r in counts if r.fold == k)
        # Sums of all rows' gradients stay below 2^62.
        most = max([1.0, *[w for pair in self.weights for w in pair]])
        self.unit = 2.0 ** min(24, 61 - math.ceil(math.log2(max(2, self.n) * most)))
        self.since: list[list[Tree]] = [[] for _ in range(folds)]

    def _read(self, since: list[list[Tree]]):
        """A function of a batch: key, y, fold, bins, margins with the trees since."""
        width, folds = self.width, self.folds

        def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            key, y, fold = (b.column(k).to_numpy() for k in range(3))
            bins, margins = _packed(b.column(3), np.uint8, width), _packed(b.column(4), float, folds).copy()
            for k, trees in enumerate(since):
                for t in trees:
                    margins[:, k] += t.value[t.nodes(bins)]
            return key, y, fold, bins, margins

        return read

    def write(self) -> None:
        """Margins with all trees so far are written anew."""
        read, out = self._read(self.since), pa.schema([("key", pa.int64()), ("y", pa.int32()), ("fold", pa.int32()), ("bins", pa.binary()), ("margins", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                margins = read(b)[4]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in margins], pa.binary())], schema=out)

        before, self.rows = self.rows, materialize(self.rows.mapInArrow(run, "key long, y int, fold int, bins binary, margins binary"))
        release(before)
        self.since = [[] for _ in range(self.folds)]

    def level(self, turn: int, grown: Mapping[int, Tree], depth: int) -> tuple[dict[tuple[int, int], tuple], dict[int, float]]:
        """Of each model and node of a level the best split (gain, feature, cut, left and all sums of g, h, n); at level 0 also each model's loss on its own fold."""
        p, read, weights, unit, width = self.p, self._read(self.since), self.weights, self.unit, self.width
        models, first, count, bins = sorted(grown), 2**depth - 1, 2**depth, p.bins
        masks = {k: chosen(width, p.seed, turn, k, p.columns) for k in models}
        out = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(models), count, width, bins), np.int64)
            loss = np.zeros(len(models), np.int64)
            for b in batches:
                key, y, fold, x, margins = read(b)
                for i, k in enumerate(models):
                    if depth == 0:
                        own = fold == k
                        loss[i] += np.rint(log_loss(margins[own, k], y[own]) * 2**20).astype(np.int64).sum()
                    some = (fold != k) & sampled(key, p.seed, turn, k, p.rows)
                    node = grown[k].nodes(x[some]) - first
                    inside = node >= 0  # leaves of former levels are done
                    some[some] = inside
                    node, own = node[inside] * bins, x[some]
                    g, h = gradients(margins[some, k], y[some], weights[k], unit)
                    for f in range(width):  # batches are small enough for exact sums of doubles
                        place = node + own[:, f]
                        for j, v in enumerate((g, h, None)):
                            total[j, i, :, f] += np.bincount(place, v, count * bins).astype(np.int64).reshape(count, bins)
            rows = [(k, n, a // BLOCK, total[:, i, n, a : a + BLOCK].tobytes()) for i, k in enumerate(models) for n in range(count) if total[2, i, n, :1].any() for a in range(0, width, BLOCK)]
            if depth == 0:
                rows += [(k, -1, 0, loss[i].tobytes()) for i, k in enumerate(models)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)] if rows else [pa.array([], t) for t in out.types], schema=out)

        back = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()), ("sums", pa.list_(pa.int64()))])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, key = None, None
            for b in batches:
                key = tuple(b.column(c)[0].as_py() for c in ("model", "node", "block"))
                for x in b.column("sums"):
                    own = np.frombuffer(x.as_buffer(), np.int64)
                    total = own.copy() if total is None else total + own
            model, node, block = key
            if node < 0:
                row = (model, node, 0.0, -1, -1, total.tolist())
            else:
                g, h, n = total.reshape(3, -1, bins)
                got = gains(g / unit, h / unit, n, p)
                got[~masks[model][block * BLOCK : block * BLOCK + len(g)]] = -np.inf
                f, cut = np.unravel_index(np.argmax(got), got.shape)  # of equals the first
                left = [int(x[f, : cut + 1].sum()) for x in (g, h, n)]
                row = (model, node, float(got[f, cut]), int(f) + block * BLOCK, int(cut), [*left, *[int(x[f].sum()) for x in (g, h, n)]])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, back.types, strict=True)], schema=back)

        got = self.rows.mapInArrow(sums, "model int, node int, block int, sums binary").groupBy("model", "node", "block").applyInArrow(best, "model int, node int, gain double, feature int, cut int, sums array<long>").collect()
        splits: dict[tuple[int, int], tuple] = {}
        for r in sorted(got, key=lambda r: (r.model, r.node, -r.gain, r.feature)):
            if r.node >= 0:
                splits.setdefault((r.model, r.node), (r.gain, r.feature, r.cut, *r.sums))
        return splits, {r.model: r.sums[0] / 2**20 / max(1, self.valid[r.model]) for r in got if r.node < 0}

    def grow(self, turn: int, trees: dict[int, Tree], splits: dict) -> None:
        """The trees of a round, level by level; `splits` are those of level 0."""
        p, unit = self.p, self.unit
        for depth in range(p.depth):
            first, any_split = 2**depth - 1, False
            if depth:
                splits, _ = self.level(turn, trees, depth)
            for (k, node), (gain, feature, cut, gl, hl, nl, ga, ha, _) in splits.items():
                t, at = trees[k], first + node
                if depth == 0:
                    t.value[0] = leaf_value(ga / unit, ha / unit, p)
                if gain > LEAST_GAIN:
                    t.feature[at], t.cut[at], any_split = feature, cut, True
                    t.value[2 * at + 1], t.value[2 * at + 2] = leaf_value(gl / unit, hl / unit, p), leaf_value((ga - gl) / unit, (ha - hl) / unit, p)
            if not any_split:
                break


def fit(rows: DataFrame, features: Sequence[str], *, label: str = "response", fold: str = "cv_fold", folds: int = 5, key: str = "id", params: Params = Params(), state: str | None = None, edges: list[list[float]] | None = None) -> FoldModels:
    """A model for each fold, by boosting on the rows of all others; classes weigh the same.

    A null label is 0, a null fold belongs to no fold's own rows. Features are numeric; nulls
    and NaN go with the smallest values. The driver holds trees and, for each level of a round,
    a row for each model, node and block of 32 features; a task 24 bytes for each model, node,
    feature and bin. An empty table gives models without trees, whose scores are one half.
    """
    if not 3 <= params.bins <= 255:
        raise ValueError("bins fit into a byte, and there are 3 at least")
    require(rows, key, label, fold, *features)
    spark, p = rows.sparkSession, params
    done = _state(spark, state) if state else None
    edges = done.edges if done else bin_edges(rows, features, p.bins) if edges is None else edges
    data = _Training(rows.withColumn(fold, F.coalesce(F.col(fold), F.lit(-1))), features, edges, label, fold, folds, key, p)
    out = done or FoldModels(tuple(features), edges, [[] for _ in range(folds)], [[] for _ in range(folds)], {})
    if out.features != tuple(features):
        raise ValueError(f"the state has the features {out.features}")
    data.since = [list(t) for t in out.trees]
    if any(data.since):
        data.write()
    live = [k for k in range(folds) if not _ended(out.losses[k], p.patience)]
    for turn in range(max([0, *map(len, out.trees)]), p.rounds + 1):
        if not live or not data.n:
            break
        trees = {k: Tree.empty(p.depth) for k in live}
        splits, losses = data.level(turn, trees, 0)
        for k in live:
            out.losses[k].append(losses.get(k, 0.0))  # of the first `turn` trees
        live = [k for k in live if not _ended(out.losses[k], p.patience)]
        if turn == p.rounds or not live:
            break
        trees = {k: trees[k] for k in live}
        data.grow(turn, trees, {s: v for s, v in splits.items() if s[0] in trees})
        for k in live:
            out.trees[k].append(trees[k])
            data.since[k].append(trees[k])
        if (turn + 1) % p.keep == 0:
            data.write()
            if state:
                _put(spark, out, f"{state}/round={turn + 1:06d}")
    release(data.rows)
    out.trees = [t[: int(np.argmin(losses))] if losses else t for t, losses in zip(out.trees, out.losses, strict=True)]
    return out


def _ended(losses: list[float], patience: int) -> bool:
    return len(losses) > patience and int(np.argmin(losses)) < len(losses) - patience


def _scores(models: FoldModels, rows: DataFrame, keep: Sequence[str], name: str, fold: str | None) -> DataFrame:
    """keep and `name`: the mean probability of all models, or with `fold` that of the row's own one (the mean, if it has none)."""
    require(rows, *keep, *models.features, *([fold] if fold else []))
    own = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    chosen_ = rows.select(F.struct(*keep).alias("k"), own.alias("f"), *_doubles(models.features))
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            bins, f = binned(_values(b, 2), m.edges), b.column(1).to_numpy()
            each = np.stack([1 / (1 + np.exp(-m.margins(bins, k))) for k in range(len(m.trees))], axis=1)
            mean = each.mean(axis=1)
            known = (f >= 0) & (f < each.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(known, each[np.arange(len(f)), np.where(known, f, 0)], mean))], names=["k", name])

    kept = rows.select(F.struct(*keep).alias("k")).schema["k"].dataType.simpleString()
    return chosen_.mapInArrow(run, f"k {kept}, {name} double").select("k.*", name)


def scores(models: FoldModels, rows: DataFrame, *keep: str, name: str = "pred") -> DataFrame:
    """The columns `keep` of rows and the mean probability of all models, in one pass over the rows. Labels aren't read."""
    return _scores(models, rows, keep, name, None)


def out_of_fold(models: FoldModels, rows: DataFrame, *keep: str, fold: str = "cv_fold", name: str = "oof_pred") -> DataFrame:
    """The columns `keep` of rows and the probability by the model that hasn't learned from the row's fold."""
    return _scores(models, rows, keep, name, fold)


def described(models: FoldModels, rows: DataFrame, model_name: str, *, label: str = "response", fold: str = "cv_fold", key: str = "id") -> FoldModels:
    """The models with what is said of them when they are stored: thresholds of best MCC, out of fold, overall and in each fold, rows, and the fingerprint of their data."""
    oof = materialize(out_of_fold(models, rows, key, label, fold).withColumn("q", F.floor(F.col("oof_pred") * 10_000 + 0.5).cast("int")))
    told = []
    for k in range(len(models.trees)):
        own = oof.where(F.col(fold) == k)
        n = own.count()
        best = best_threshold(own, label).first() if n else None
        told.append({"fold": k, "rows": n, "threshold": best.threshold if best else 0.5, "mcc": best.mcc if best else 0.0})
    whole = best_threshold(oof, label).first() if oof.count() else None
    meta = {"model_name": model_name, "feature_cols": list(models.features), "threshold": whole.threshold if whole else 0.5, "oof_mcc": whole.mcc if whole else 0.0, "training_rows": oof.count(), "folds": told, "data_fingerprint": fingerprint(rows, list(models.features), key, label)}
    release(oof)
    return dataclasses.replace(models, meta=meta)


def _table(models: FoldModels) -> list[tuple]:
    return [(k, t, i, int(tree.feature[i]), int(tree.cut[i]), float(tree.value[i])) for k, trees in enumerate(models.trees) for t, tree in enumerate(trees) for i in range(len(tree.feature))]


TREES = "model int, round int, node int, feature int, cut int, value double"


def _digest(table: list[tuple], edges: list[list[float]]) -> str:
    return hashlib.sha256(json.dumps([sorted(table), edges]).encode()).hexdigest()


def _put(spark: SparkSession, models: FoldModels, path: str) -> None:
    table = _table(models)
    told = {"features": list(models.features), "edges": models.edges, "losses": models.losses, "models": len(models.trees), "meta": models.meta, "digest": _digest(table, models.edges)}
    spark.createDataFrame(table, TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").text(f"{path}/about")  # last: without it nothing is stored


def _get(spark: SparkSession, path: str) -> FoldModels:
    if not exists(spark, f"{path}/about/_SUCCESS"):
        raise FileNotFoundError(f"no models at {path}")
    try:
        told = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        table = [tuple(r) for r in spark.read.schema(TREES).parquet(f"{path}/trees").collect()]
        features, edges, digest = tuple(told["features"]), told["edges"], told["digest"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"what is stored at {path} can't be read") from e
    if _digest(table, edges) != digest:
        raise ValueError(f"the trees at {path} aren't those that were stored")
    trees: list[list[Tree]] = [[] for _ in range(told["models"])]
    sizes: dict[tuple[int, int], int] = {}
    for k, t, *_ in table:
        sizes[k, t] = sizes.get((k, t), 0) + 1
    for k, t in sorted(sizes):
        trees[k].append(Tree.empty(int(math.log2(sizes[k, t] + 1)) - 1))
    for k, t, i, feature, cut, value in table:
        tree = trees[k][t]
        tree.feature[i], tree.cut[i], tree.value[i] = feature, cut, value
    return FoldModels(features, edges, trees, told["losses"], told["meta"])


def _state(spark: SparkSession, path: str) -> FoldModels | None:
    """The models of the last round that a broken run has written."""
    if not exists(spark, path):
        return None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    for name in sorted((f.getPath().getName() for f in found if f.getPath().getName().startswith("round=")), reverse=True):
        if exists(spark, f"{path}/{name}/about/_SUCCESS"):
            return _get(spark, f"{path}/{name}")
    return None


def save(models: FoldModels, spark: SparkSession, path: str) -> None:
    """Trees as Parquet, and what is said of them as JSON, last. Models that fail a check of stored metadata aren't stored."""
    if bad := model_problems(models.meta):
        raise ValueError(f"metadata without {bad}")
    _put(spark, models, path)


def load(spark: SparkSession, path: str, contract: Sequence[str] | None = None) -> FoldModels:
    """The stored models; an error if anything is missing, damaged, or made for other features than the contract's (in its order)."""
    got = _get(spark, path)
    if bad := model_problems(got.meta):
        raise ValueError(f"metadata without {bad}")
    if list(got.features) != list(got.meta["feature_cols"]) or contract is not None and list(contract) != list(got.features):
        raise ValueError(f"the models' features are {list(got.features)}")
    return got
