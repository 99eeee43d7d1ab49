"""Drift of scores and columns between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.exprs import ratio
from faultline.sources.scratch import materialize

from .ordered import lagged, running

#: Columns that name or place rows and are no features, in any case.
STRUCTURAL = frozenset({"id", "row_id", "index", "batch_id", "cycle_id", "run_seq", "scored_at_utc", "decision", "auto_reject", "manual_inspect"})


def temporal_split(rows: DataFrame, order: str, share: int = 70, key: str = "id") -> DataFrame:
    """rows with is_current: false for the first `share` percent in the order, at least one row on either side."""
    n = rows.count()
    cut = max(1, min(n * share // 100, n - 1))
    return running(rows, [F.col(order), F.col(key)]).withColumn("is_current", F.col("pos") >= cut).drop("pos")


def tallied(reference: DataFrame, current: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """column_name, v (of the type `kind`), a and b: how often each value of each column is in either table. One pass over each table; columns become rows before anything is counted or moved."""
    def of(df: DataFrame, a: int) -> DataFrame:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("v")) for c in columns])).alias("x"))
        return cells.select("x.column_name", "x.v", F.lit(a).cast("long").alias("a"), F.lit(1 - a).cast("long").alias("b"))

    return of(reference, 1).union(of(current, 0)).groupBy("column_name", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _features(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.lower() not in STRUCTURAL]


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def numeric_distances(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, distance (Wasserstein over the reference's deviation) and ks of numeric columns, all of them put in order together.

    Nulls and NaN are left out. A column without a value in one of the tables has no distance.
    """
    if not columns:
        return _none(reference, "column_name string, distance double, ks double")
    counts = tallied(reference, current, columns, "double").where("v IS NOT NULL AND NOT isnan(v)")
    by = ["column_name"]
    placed = materialize(lagged(running(counts, [F.col("v")], {"ca": F.col("a"), "cb": F.col("b")}, by=by), "pos", {"after": (F.col("v"), -1)}, by))
    n = placed.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # a row for each column
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    mean = F.sum(F.col("a") * F.col("v")) / F.sum("a")
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("a") * F.col("v") ** 2) / F.sum("a") - mean**2))
    got = placed.join(F.broadcast(n), by).groupBy(*by).agg(F.sum(gap * F.coalesce(F.col("after") - F.col("v"), F.lit(0.0))).alias("w"), F.max(gap).alias("ks"), F.when(F.sum("a") > 0, std).alias("s"))
    return got.select("column_name", F.when(F.col("ks").isNotNull(), ratio(F.col("w"), F.col("s"))).alias("distance"), "ks")


def category_distances(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, distance (Jensen-Shannon, from 0 to 1), chi_square (of the two tables' counts), degrees, and unseen (categories that only the current table has).

    A null is a category of its own, and so is every value that only one table has. A column of an empty table has no distance.
    """
    if not columns:
        return _none(reference, "column_name string, distance double, chi_square double, degrees long, unseen long")
    counts = materialize(tallied(reference, current, columns, "string"))
    n = counts.groupBy("column_name").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = F.try_divide("a", "na"), F.try_divide("b", "nb")
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    both = (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    square = (F.col("a") - F.col("na") * both) ** 2 / (F.col("na") * both) + (F.col("b") - F.col("nb") * both) ** 2 / (F.col("nb") * both)
    known = (F.col("na") > 0) & (F.col("nb") > 0)
    cells = counts.join(F.broadcast(n), "column_name").select("column_name", "a", "b", F.when(known, (part(p) + part(q)) / 2).alias("js"), F.when(known, square).alias("square"))
    return cells.groupBy("column_name").agg(F.when(F.count("js") > 0, F.sqrt(F.greatest(F.lit(0.0), F.sum("js")))).alias("distance"), F.sum("square").alias("chi_square"), (F.count("*") - 1).alias("degrees"), F.count_if(F.col("a") == 0).alias("unseen"))


def drift_table(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """column_name, distance (Wasserstein over the reference's deviation), ks, p_value (of the KS statistic) and drifted, for numeric columns.

    Structural columns are left out. A column drifts if its distance is above the threshold;
    p_drifted says the same of a p-value below 0.05. Nothing but structural columns: no rows.
    """
    n, m = reference.count(), current.count()
    out = numeric_distances(reference, current, _features(columns)).withColumn("p_value", ks_p_value(F.col("ks"), n * m / max(1, n + m)))
    return out.withColumns({"drifted": F.col("distance") > threshold, "p_drifted": F.col("p_value") < 0.05})


def drift_report(reference: DataFrame, current: DataFrame, threshold: float = 0.1, *, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None) -> DataFrame:
    """A row for each column that both tables have (or that is named): column_name, kind, distance, ks, chi_square, degrees, unseen and drifted (distance above the threshold).

    Numbers are compared by drift_table's distance, strings and booleans as categories. Structural columns are left out.
    """
    shared = [(f.name, f.dataType.simpleString()) for f in reference.schema if f.name in current.columns]
    if numeric is None:
        numeric = [c for c, t in shared if t.startswith("decimal") or t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    if categorical is None:
        categorical = [c for c, t in shared if t in ("string", "boolean")]
    a = numeric_distances(reference, current, _features(numeric)).withColumn("kind", F.lit("numeric"))
    b = category_distances(reference, current, _features(categorical)).withColumn("kind", F.lit("category"))
    got = a.unionByName(b, allowMissingColumns=True).withColumn("drifted", F.coalesce(F.col("distance") > threshold, F.lit(False)))
    return got.select("column_name", "kind", "distance", "ks", "chi_square", "degrees", "unseen", "drifted")


def ks_p_value(ks: Column, n: float, terms: int = 20) -> Column:
    """Asymptotic p-value of a two-sample Kolmogorov-Smirnov statistic with an effective size of n."""
    x = ks**2 * F.lit(-2.0 * n)
    total = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(x * k * k) for k in range(2, terms + 1)), F.lit(2.0) * F.exp(x))
    return F.when(ks**2 * n < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))  # the series needs more terms near 0, where it is 1


def drift_summary(table: DataFrame, score: str = "q") -> DataFrame:
    """Share of drifted columns and the score's own distance; the score isn't counted among the columns."""
    own, rest = F.col("column_name") == score, F.col("column_name") != score
    n, flagged = F.count_if(rest), F.count_if(rest & F.col("drifted"))
    return table.agg(n.alias("columns"), flagged.alias("drifted_columns"), F.when(n > 0, flagged / n).otherwise(F.lit(0.0)).alias("share"), F.max(F.when(own, F.col("distance"))).alias("score_distance"), F.max(F.when(own, F.col("drifted").cast("int"))).alias("score_drifted"))
