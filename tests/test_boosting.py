"""Boosting on histograms against plain numpy loops; storage, resumption and scoring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import boosting as B


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 1] = np.round(x[:, 1], 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.7 > 1).astype(int)
    rows = [(k, int(y[k]), k % 3, float(x[k, 0]), None if k % 11 == 0 else float(x[k, 1]), float("nan") if k % 13 == 0 else float(x[k, 2]), "other") for k in range(n)]
    return spark.createDataFrame(rows, "id long, response int, cv_fold int, a double, b double, c double, key string").repartition(4)


def plain(df, edges, p, folds=3):
    """One row, node and cut after the other."""
    rows = df.select(F.xxhash64("id").alias("h"), "response", "cv_fold", "a", "b", "c").collect()
    key, y, fold = (np.array([r[k] for r in rows]) for k in range(3))
    bins = np.array([[0 if v is None or math.isnan(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r[3:])] for r in rows])
    n = len(rows)
    out = []
    weights = []
    for k in range(folds):
        m, pos = int((fold != k).sum()), int(y[fold != k].sum())
        weights.append((m / (2 * (m - pos)), m / (2 * pos)))
    unit = 2.0 ** min(24, 61 - math.ceil(math.log2(n * max(max(w) for w in weights + [(1.0, 1.0)]))))
    for k in range(folds):
        margin, losses, trees = np.zeros(n), [], []
        for turn in range(p.rounds + 1):
            losses.append(sum(int(np.rint(v * 2**20)) for v in B.log_loss(margin[fold == k], y[fold == k])) / 2**20 / (fold == k).sum())
            if turn == p.rounds or len(losses) > p.patience and losses.index(min(losses)) < len(losses) - p.patience:
                break
            some = (fold != k) & B.sampled(key, p.seed, turn, k, p.rows)
            g, h = B.gradients(margin, y, weights[k], unit)
            allowed = np.flatnonzero(B.chosen(3, p.seed, turn, k, p.columns))

            def grow(rows_, depth):
                G, H = g[rows_ & some].sum() / unit, h[rows_ & some].sum() / unit
                score = lambda a, b: max(0.0, abs(a) - p.l1) ** 2 / (b + p.l2)
                best = (B.LEAST_GAIN, None, None)
                for f in allowed if depth < p.depth else []:
                    for cut in range(p.bins - 1):
                        left = rows_ & some & (bins[:, f] <= cut)
                        nl, nr = left.sum(), (rows_ & some).sum() - left.sum()
                        if nl >= p.leaf and nr >= p.leaf:
                            gl, hl = g[left].sum() / unit, h[left].sum() / unit
                            gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                            if gain > best[0]:
                                best = (gain, f, cut)
                if best[1] is None:
                    margin[rows_] += B.leaf_value(G, H, p)
                    return None
                _, f, cut = best
                return (f, cut, grow(rows_ & (bins[:, f] <= cut), depth + 1), grow(rows_ & (bins[:, f] > cut), depth + 1))

            trees.append(grow(np.ones(n, bool), 0))
        out.append((trees[: int(np.argmin(losses))], losses))
    return out


def nested(t, at=0):
    return None if t.feature[at] < 0 else (int(t.feature[at]), int(t.cut[at]), nested(t, 2 * at + 1), nested(t, 2 * at + 2))


SMALL = B.Params(rounds=5, rate=0.3, depth=2, leaf=20, bins=8, patience=2, keep=2)
X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = table(spark).cache()
    return df, B.fit(df, X, folds=3, params=SMALL)


def test_equals_plain_loops(fitted):
    df, got = fitted
    want = plain(df, got.edges, SMALL)
    for k in range(3):
        trees, losses = want[k]
        assert [nested(t) for t in got.trees[k]] == trees and len(trees) >= 3
        assert got.losses[k] == pytest.approx(losses, abs=1e-9)


def test_dealing_of_rows_changes_nothing(fitted):
    df, got = fitted
    again = B.fit(df.repartition(2), X, folds=3, params=SMALL, edges=got.edges)
    assert B._table(again) == B._table(got) and again.losses == got.losses


def test_patience_keeps_the_best_round(spark):
    """Labels without any sense: rounds end early, and what is kept has the smallest loss."""
    df = table(spark, 300).withColumn("response", (F.xxhash64("id") % 2 == 0).cast("int"))
    got = B.fit(df, X, folds=3, params=B.Params(rounds=30, rate=0.5, depth=2, leaf=10, bins=8, patience=2))
    for k in range(3):
        assert len(got.trees[k]) == int(np.argmin(got.losses[k])) < 28 and len(got.losses[k]) < 31


def test_broken_run_goes_on(spark, fitted, tmp_path):
    df, whole = fitted
    state = f"file://{tmp_path}/state"
    few = B.Params(**{**SMALL.__dict__, "rounds": 2})
    B.fit(df, X, folds=3, params=few, state=state, edges=whole.edges)
    got = B.fit(df, X, folds=3, params=SMALL, state=state)
    assert B._table(got) == B._table(whole)


def test_store_and_score(spark, fitted, tmp_path):
    df, models = fitted
    path = f"file://{tmp_path}/models"
    with pytest.raises(ValueError, match="metadata"):
        B.save(models, spark, path)
    told = B.described(models, df, "small")
    B.save(told, spark, path)
    got = B.load(spark, path, X)
    assert got.meta == told.meta and got.meta["training_rows"] == 600 and got.meta["oof_mcc"] > 0.3 and len(got.meta["folds"]) == 3
    before = sorted(map(tuple, B.scores(models, df, "id").collect()))
    assert sorted(map(tuple, B.scores(got, df.drop("response"), "id").collect())) == before
    bins = {r.id: B.binned(np.array([[np.nan if v is None else v for v in (r.a, r.b, r.c)]]), got.edges) for r in df.collect()}
    for k, pred in before[:20]:
        assert pred == pytest.approx(np.mean([1 / (1 + math.exp(-sum(t.value[t.nodes(bins[k])[0]] for t in trees))) for trees in got.trees]))
    oof = {r.id: r.oof_pred for r in B.out_of_fold(got, df, "id").collect()}
    assert oof[7] == pytest.approx(float(1 / (1 + np.exp(-got.margins(bins[7], 1)))[0]))
    with pytest.raises(ValueError, match="features"):
        B.load(spark, path, ["b", "a", "c"])
    with pytest.raises(FileNotFoundError):
        B.load(spark, path + "x")
    spark.read.parquet(f"{path}/trees").withColumn("value", F.col("value") + 1).write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    with pytest.raises(ValueError, match="stored"):
        B.load(spark, path)


def test_no_rows(spark):
    got = B.fit(spark.createDataFrame([], "id long, response int, cv_fold int, a double"), ["a"], params=SMALL)
    assert [r.pred for r in B.scores(got, spark.createDataFrame([(1, 2.0)], "id long, a double"), "id").collect()] == [0.5]


def test_binaries_are_read_in_place():
    import pyarrow as pa

    rows = np.random.default_rng(0).normal(size=(50, 3))
    for kind in (pa.binary(), pa.large_binary()):
        got = B._packed(pa.array([r.tobytes() for r in rows], kind).slice(7, 20), float, 3)
        assert np.array_equal(got, rows[7:27]) and not got.flags.owndata
    assert B._packed(pa.array([], pa.binary()), float, 3).shape == (0, 3) and B._packed(pa.array([b""], pa.binary()), np.uint8, 0).shape == (1, 0)
    for bad in ([b"12345678", None], [b"12345678", b"1234"]):
        with pytest.raises(ValueError):
            B._packed(pa.array(bad, pa.binary()), float, 1)
