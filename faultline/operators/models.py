"""Out-of-fold models and ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting


def oof_predictions(rows: DataFrame, features: Sequence[str], *, label: str = "response", fold: str = "cv_fold", folds: int = 5, key: str = "id", params: boosting.Params = boosting.Params()) -> tuple[DataFrame, DataFrame]:
    """(key, label, oof_pred, fold) of every row by a model that hasn't learned from its fold, only ended early by it; and mean feature importances.

    Classes are balanced by weights. Folds are given, as whole groups where groups may not leak.
    """
    models = boosting.fit(rows, features, label=label, fold=fold, folds=folds, key=key, params=params)
    out = boosting.out_of_fold(models, rows, key, label, fold).select(key, label, "oof_pred", fold)
    return out, rows.sparkSession.createDataFrame(models.importances(), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def ensemble(rows: DataFrame, by_fold: Sequence[Sequence[str]], name: str = "pred") -> DataFrame:
    """rows with the mean over folds of the mean over seeds of the named score columns."""
    folds = [sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs) for cs in by_fold]
    return rows.withColumn(name, sum(folds[1:], folds[0]) / len(folds))


def two_stage(rows: DataFrame, first: str, second: str, run_size: str = "run_size", zero_singles: bool = False) -> DataFrame:
    """rows with pred: the second stage's score within runs of more than one row, else the first's (or 0)."""
    single = F.lit(0.0) if zero_singles else F.col(first)
    return rows.withColumn("pred", F.when(F.col(run_size) > 1, F.coalesce(F.col(second), F.col(first))).otherwise(single))
