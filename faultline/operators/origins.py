"""Rolling origins: each window of time is scored by what the windows before it tell, and logged.

The log has a partition for each origin, committed as a whole. A run that was broken off goes on
with the origins that it lacks. Whatever is said of the origins - ranking, intervals, regimes,
what lasts of a gain - is read from the log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.exprs import smoothed
from faultline.sources.ingest import exists, read_partitions, write_partition
from faultline.sources.scratch import materialize, release

from . import boosting
from .evaluate import SCALE
from .features import path_features, path_lookup
from .ordered import running

#: What scores the rows of an origin: (rows before, rows of the window) -> the window's rows with `pred`.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def time_parts(rows: DataFrame, parts: int, t: str = "start_time", key: str = "id") -> DataFrame:
    """rows with part: so many windows of about as many rows each, in the order of (t, key)."""
    n = rows.count()
    return running(rows, [F.col(t), F.col(key)], position="__pos").withColumn("part", F.floor(F.col("__pos") * parts / F.lit(max(1, n))).cast("int")).drop("__pos")


def path_rates(m: float = 10.0, label: str = "response", signature: str = "path_signature") -> Scorer:
    """Scores by the path's past rate, shrunk towards the past's overall rate, which unknown paths have."""

    def score(before: DataFrame, window: DataFrame) -> DataFrame:
        overall = before.agg(F.avg(label)).first()[0] or 0.0
        known = before.groupBy(F.col(signature).alias("__s")).agg(smoothed(F.count("*"), F.avg(label), F.lit(overall), m).alias("__r"))
        return window.join(known, F.col(signature).eqNullSafe(F.col("__s")), "left").withColumn("pred", F.coalesce("__r", F.lit(overall))).drop("__s", "__r")

    return score


def boosted(features: Sequence[str], params: boosting.Params = boosting.Params(), label: str = "response", signature: str = "path_signature", key: str = "id") -> Scorer:
    """Scores by trees over the features and the path features, which are made anew from the rows before only; a fifth of these, by key, ends the rounds."""
    made = ("transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std", "station_risk_mean", "path_count", "pair_cooccur_mean", "pair_cooccur_max", "pair_cooccur_std")

    def score(before: DataFrame, window: DataFrame) -> DataFrame:
        overall = before.agg(F.avg(label)).first()[0] or 0.0
        lookup = {k: materialize(v) for k, v in path_lookup(before, label=label, signature=signature).items()}
        held = F.when(F.pmod(F.xxhash64(key), F.lit(5)) == 0, 0).otherwise(-1)
        train = path_features(before, lookup, overall, signature=signature).withColumn("__fold", held)
        models = boosting.fit(train, [*features, *made], label=label, fold="__fold", folds=1, key=key, params=params)
        got = materialize(boosting.scores(models, path_features(window, lookup, overall, signature=signature), *window.columns))
        release(*lookup.values())
        return got

    return score


def run_origins(rows: DataFrame, score: Scorer, log: str, *, label: str = "response", key: str = "id") -> DataFrame:
    """fold, key, label and q (score on the grid) of the windows 1 and on of rows (with `part`), each scored by those before it.

    Origins that the log has are not made again.
    """
    spark = rows.sparkSession
    last = rows.agg(F.max("part")).first()[0] or 0
    for k in range(1, last + 1):
        if exists(spark, f"{log}/fold={k}/_SUCCESS"):
            continue
        window = rows.where(F.col("part") == k)
        got = score(rows.where(F.col("part") < k), window).select(key, label, F.floor(F.col("pred") * SCALE + 0.5).cast("int").alias("q"))
        write_partition(got, log, {"fold": k})
    return read_partitions(spark, log, label=(), order="")


def regime(intervals: DataFrame, high: Sequence[int] = (1, 2), low: Sequence[int] = (3, 4), drop: float = 0.05) -> DataFrame:
    """One row: regime, and what it follows from. intervals: fold, metric (auc, lift), mean, low, high.

    B: all intervals of AUC and of lift of the low folds meet those of the high folds. C: lift
    doesn't, or has no interval, or the mean AUC has dropped by more than `drop`. Else mixed. Null
    and NaN are no intervals.
    """
    known = intervals.where(F.col("low").isNotNull() & ~F.isnan("low") & F.col("high").isNotNull() & ~F.isnan("high"))
    side = lambda folds, x: known.where(F.col("fold").isin(list(folds))).select("metric", F.col("low").alias(f"{x}l"), F.col("high").alias(f"{x}h"))
    meets = (F.col("al") <= F.col("bh")) & (F.col("bl") <= F.col("ah"))
    pairs = side(low, "a").join(side(high, "b"), "metric").agg(*[F.bool_and(F.when(F.col("metric") == m, meets)).alias(f"{m}_over") for m in ("auc", "lift")])
    mean = lambda m, folds: F.avg(F.when((F.col("metric") == m) & F.col("fold").isin(list(folds)), F.col("mean")))
    falls = known.agg(*[(mean(m, high) - mean(m, low)).alias(f"{m}_drop") for m in ("auc", "lift")])
    auc, lift = F.coalesce("auc_over", F.lit(False)), F.coalesce("lift_over", F.lit(False))
    rule = F.when(auc & lift, "B").when(~lift | F.coalesce(F.col("auc_drop") > drop, F.lit(False)), "C").otherwise("mixed")
    return pairs.join(F.broadcast(falls)).select(rule.alias("regime"), "auc_over", "lift_over", "auc_drop", "lift_drop")


def out_of_fold_path_rates(rows: DataFrame, fold: str, m: float = 10.0, label: str = "response", signature: str = "path_signature") -> DataFrame:
    """rows with pred: the score of path_rates by all rows of other folds; counts of a fold are taken from those of all, so rows aren't repeated."""
    y = F.coalesce(F.sum(label), F.lit(0)).cast("long")
    by = rows.groupBy(F.col(signature).alias("__s"), F.col(fold).alias("__f")).agg(F.count("*").alias("n"), y.alias("pos"))
    all_ = by.groupBy(F.col("__s").alias("__t")).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    folds = by.groupBy(F.col("__f").alias("__g")).agg(F.sum("n").alias("fold_n"), F.sum("pos").alias("fold_pos"))
    whole = folds.agg(F.sum("fold_n").alias("whole_n"), F.sum("fold_pos").alias("whole_pos"))  # one row
    got = by.join(all_, F.col("__s").eqNullSafe(F.col("__t"))).join(folds, F.col("__f").eqNullSafe(F.col("__g"))).join(F.broadcast(whole))
    n, overall = F.col("all_n") - F.col("n"), F.coalesce(F.try_divide(F.col("whole_pos") - F.col("fold_pos"), F.col("whole_n") - F.col("fold_n")), F.lit(0.0))
    rate = F.when(n > 0, smoothed(n, F.try_divide(F.col("all_pos") - F.col("pos"), n), overall, m)).otherwise(overall)
    known = got.select("__s", "__f", rate.alias("pred"))
    return rows.join(known, F.col(signature).eqNullSafe(F.col("__s")) & F.col(fold).eqNullSafe(F.col("__f"))).drop("__s", "__f")
