"""Group-aware folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.sources.scratch import materialize

from .ordered import running


def leaks(rows: DataFrame, group: str, fold: str) -> DataFrame:
    """group, the number of folds that it is in, and whether these are too many."""
    by = rows.select(group, fold).distinct().groupBy(group).agg(F.count("*").alias("folds"))
    return by.withColumn("leaks", F.col("folds") > 1)


#: Groups that are dealt one by one on the driver, at most.
ONE_BY_ONE = 100_000


def group_folds(rows: DataFrame, group: str, label: str, folds: int = 5, *, one_by_one: int = ONE_BY_ONE) -> DataFrame:
    """rows with cv_fold: whole groups, dealt so that folds have about as many positives and rows each.

    Up to `one_by_one` groups are dealt on the driver, largest number of positives first (then
    of rows, then by group), to the fold that is then the most even. More are put in that order
    by ranges and dealt forth and back (0 to 4, 4 to 0), without leaving the executors: two folds'
    positives then differ by no more than the largest group has, and their rows of groups of one
    number of positives by no more than twice the largest of these. Rows without a group are a group.
    """
    counts = materialize(rows.groupBy(group).agg(F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("pos"), F.count("*").alias("n")))
    found = counts.count()
    if found < folds:
        raise ValueError(f"{folds} folds need as many groups; there are {found}")
    if found > one_by_one:
        placed = running(counts, [F.desc("pos"), F.desc("n"), F.col(group)], position="__p")
        turn = F.pmod(F.col("__p"), F.lit(2 * folds))
        dealt = placed.select(F.col(group).alias("__group"), F.least(turn, 2 * folds - 1 - turn).cast("int").alias("cv_fold"))
    else:
        dealt = F.broadcast(_one_by_one(counts, group, folds))
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def _one_by_one(counts: DataFrame, group: str, folds: int) -> DataFrame:
    rows = counts.collect()
    have, dealt = [[0, 0] for _ in range(folds)], []
    pos, n = max(1, sum(r.pos for r in rows)), max(1, sum(r.n for r in rows))
    for r in sorted(rows, key=lambda r: (-r.pos, -r.n, r[group] is not None, r[group])):
        k = min(range(folds), key=lambda f: ((have[f][0] + r.pos) / pos + (have[f][1] + r.n) / n, f))
        have[k] = [have[k][0] + r.pos, have[k][1] + r.n]
        dealt.append((r[group], k))
    schema = T.StructType([T.StructField("__group", counts.schema[group].dataType), T.StructField("cv_fold", T.IntegerType())])
    return counts.sparkSession.createDataFrame(dealt, schema)
