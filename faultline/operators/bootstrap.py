"""Bootstrap intervals of ranking statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import SCALE, score_counts

#: Least number of valid replicates for an interval.
LEAST_VALID = 10


def _auc_ap(pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """AUC and average precision from counts at descending scores."""
    p, n = pos.sum(), neg.sum()
    tp = np.cumsum(pos)
    auc = float((neg * (tp - pos / 2)).sum() / (p * n))
    total = tp + np.cumsum(neg)
    ap = float((pos * tp / np.maximum(total, 1)).sum() / p)
    return auc, ap


def bootstrap_replicates(scored: DataFrame, replicates: int = 200, seed: int = 12345, label: str = "response", positives: int | None = None) -> DataFrame:
    """replicate, auc and lift of resampled tables; replicates of one class are left out.

    Rows of one score and class are alike, so a resample is a multinomial draw over the counts
    at each score: a table of at most 10,001 rows however many rows there are, sent to tasks
    that make replicates side by side. With `positives`, that many are first drawn without
    replacement (a control of equal prevalence).
    """
    counts = score_counts(scored, label).orderBy(F.desc("q")).toPandas()
    pos, neg = counts["pos"].to_numpy(), (counts["n"] - counts["pos"]).to_numpy()
    spark = scored.sparkSession
    sent = spark.sparkContext.broadcast((pos, neg))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, n = sent.value
        for f in frames:
            rows = []
            for k in f["id"]:
                rng = np.random.default_rng([seed, int(k)])
                own = p
                if positives is not None:
                    own = rng.multivariate_hypergeometric(p, min(positives, int(p.sum())))
                both = np.concatenate([own, n])
                if not both.sum():
                    continue
                draw = rng.multinomial(int(both.sum()), both / both.sum())
                a, b = draw[: len(own)], draw[len(own) :]
                if a.sum() and b.sum():
                    auc, ap = _auc_ap(a, b)
                    rows.append((int(k), auc, ap / (a.sum() / (a.sum() + b.sum()))))
            yield pd.DataFrame(rows, columns=["replicate", "auc", "lift"]).astype({"replicate": "int64", "auc": float, "lift": float})

    return spark.range(replicates).repartition(8).mapInPandas(run, "replicate long, auc double, lift double")


def bootstrap_interval(scored: DataFrame, replicates: int = 200, seed: int = 12345, level: float = 95.0, label: str = "response", positives: int | None = None) -> DataFrame:
    """metric, low, high and the number of valid replicates; NaN with fewer than LEAST_VALID."""
    got = bootstrap_replicates(scored, replicates, seed, label, positives)
    long = got.select(F.explode(F.create_map(F.lit("auc"), F.col("auc"), F.lit("lift"), F.col("lift"))).alias("metric", "x"))
    a, b = (100 - level) / 200, 1 - (100 - level) / 200
    got = long.groupBy("metric").agg(F.count("*").alias("valid"), F.percentile("x", F.lit(a)).alias("low"), F.percentile("x", F.lit(b)).alias("high"))
    return got.select("metric", "valid", *[F.when(F.col("valid") >= LEAST_VALID, F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in ("low", "high")])


#: Metrics of a resampled table.
METRICS = ("auc", "average_precision", "lift", "top_precision", "top_recall", "brier", "cost_per_100k_rows")


def cell_metrics(q: np.ndarray, pos: np.ndarray, neg: np.ndarray, *, permille: int = 10, threshold: int = 6000) -> dict[str, float]:
    """Metrics of counts of both classes at descending scores on the grid; rows of the last score within the top share count in proportion."""
    auc, ap = _auc_ap(pos, neg)
    p, n = float(pos.sum()), float(pos.sum() + neg.sum())
    k = max(1.0, np.ceil(n * permille / 1000))
    ahead = np.cumsum(pos + neg) - (pos + neg)
    found = float((pos * np.clip((k - ahead) / np.maximum(pos + neg, 1), 0, 1)).sum())
    s = q / SCALE
    flagged = q >= threshold
    lost = float(100 * pos[~flagged].sum() + 5 * neg[flagged].sum())
    return dict(zip(METRICS, (auc, ap, ap / (p / n), found / k, found / p, float((pos * (1 - s) ** 2 + neg * s**2).sum() / n), lost / n * 100_000), strict=True))


def needed(negatives: int, prevalence: float) -> int:
    """Positives that give the prevalence beside so many negatives."""
    return int(np.rint(negatives * prevalence / (1 - prevalence)))


def status_of(positives: int, negatives: int, need: int | None) -> str:
    if not positives or not negatives:
        return "one_class"
    if need is None:
        return "feasible"
    return "none_left" if need < 1 else "too_few" if need > positives else "feasible"


def resampled(scored: DataFrame, *by: str, replicates: int = 200, seed: int = 12345, label: str = "response", prevalence: float | None = None, permille: int = 10, threshold: int = 6000, level: float = 95.0, chunk: int = 25) -> DataFrame:
    """by, metric, mean, low, high, valid, status, need and available: bootstrap intervals of all METRICS for each group.

    With `prevalence`, each replicate first draws as many positives, without replacement, as give
    that prevalence beside all negatives: a control that differs in nothing but prevalence. A group that
    hasn't as many, or lacks a class, has one row that says so, with a null metric. Groups go
    as counts at each score, at most 10,001; fewer than LEAST_VALID replicates give NaN.
    """
    counts = scored.where(F.col("q").isNotNull()).groupBy(*by, "q").agg(F.sum(F.coalesce(F.col(label), F.lit(0)).cast("long")).alias("pos"), F.count("*").alias("n"))
    cells = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("q").cast("long").alias("q"), "pos", (F.col("n") - F.col("pos")).alias("neg"))), False).alias("cells"))  # the grid bounds the list
    draws = cells.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(0, replicates - 1)), F.lit(chunk))))
    keys = cells.select(*by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                q, pos, neg = (np.array([c[k] for c in r["cells"]], np.int64) for k in ("q", "pos", "neg"))
                need = None if prevalence is None else needed(int(neg.sum()), prevalence)
                own = tuple(r[c] for c in by)
                state = status_of(int(pos.sum()), int(neg.sum()), need)
                if state != "feasible":
                    rows += [(*own, None, -1, float("nan"), state, need, int(pos.sum()))] if r["first"] == 0 else []
                    continue
                for k in range(r["first"], min(replicates, r["first"] + chunk)):
                    rng = np.random.default_rng([seed, k])
                    some = pos if need is None else rng.multivariate_hypergeometric(pos, need)
                    both = np.concatenate([some, neg])
                    draw = rng.multinomial(int(both.sum()), both / both.sum())
                    a, b = draw[: len(q)], draw[len(q) :]
                    if a.sum() and b.sum():
                        rows += [(*own, m, k, v, state, need, int(pos.sum())) for m, v in cell_metrics(q, a, b, permille=permille, threshold=threshold).items()]
            yield pd.DataFrame(rows, columns=[*by, "metric", "replicate", "x", "status", "need", "available"]).astype({"replicate": "int64", "x": float, "need": "Int64", "available": "int64"})

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in keys.schema], "metric string, replicate long, x double, status string, need long, available long"])
    got = draws.repartition(8).mapInPandas(run, schema)
    a, b = (100 - level) / 200, 1 - (100 - level) / 200
    few = F.count_if(F.col("replicate") >= 0) < LEAST_VALID
    stat = lambda c: F.when(F.col("metric").isNull(), None).when(few, float("nan")).otherwise(c)
    return got.groupBy(*by, "metric", "status", "need", "available").agg(stat(F.avg("x")).alias("mean"), stat(F.percentile("x", F.lit(a))).alias("low"), stat(F.percentile("x", F.lit(b))).alias("high"), F.count_if(F.col("replicate") >= 0).alias("valid"))
