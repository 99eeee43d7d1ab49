"""Joins with checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_repeats(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side and the number of keys that are there more than once."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("repeated_keys"), F.count("*").alias("keys")).select(F.lit(name).alias("side"), "keys", "repeated_keys")

    return of(left, "left").unionByName(of(right, "right"))


def one_to_one(left: DataFrame, right: DataFrame, key: str, *, check: bool = True) -> DataFrame:
    """Inner join on key; with `check`, an error if a key isn't unique on either side (this runs a job)."""
    if check:
        bad = [r.side for r in key_repeats(left, right, key).collect() if r.repeated_keys]
        if bad:
            raise ValueError(f"{key} isn't unique on the {' and the '.join(bad)} side")
    return left.join(right, key)


def id_difference(rows: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """How many ids of the template are missing in rows, and how many of rows are extra."""
    a, b = rows.select(key).distinct(), template.select(key).distinct()
    missing = b.join(a, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "n")
    return missing.unionByName(a.join(b, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("extra").alias("kind"), "n"))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that lists the columns it lacks. Checked on the schema, no job runs."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def refuse(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error if it has one of the columns: the label-free track may not see labels."""
    there = sorted({c.lower() for c in columns} & {c.lower() for c in df.columns})
    if there:
        raise ValueError(f"columns that this track may not read: {there}")
    return df


def with_scores(rows: DataFrame, predictions: DataFrame, key: str = "id", score: str = "pred", *, check: bool = True) -> DataFrame:
    """All rows with their score, 0 where there is none, in the order of the key; with `check`, keys must be unique on both sides."""
    predictions = predictions.select(key, score)
    if check:
        bad = [r.side for r in key_repeats(rows, predictions, key).collect() if r.repeated_keys]
        if bad:
            raise ValueError(f"{key} isn't unique on the {' and the '.join(bad)} side")
    got = rows.drop(score).join(predictions, key, "left")
    return got.withColumn(score, F.coalesce(score, F.lit(0.0))).orderBy(key)


def same_count(joined: DataFrame, rows: DataFrame) -> DataFrame:
    """joined, or an error if a join has lost or repeated rows (this runs two counts)."""
    n, m = rows.count(), joined.count()
    if n != m:
        raise ValueError(f"the join has {m} rows, not {n}")
    return joined


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and nulls (NaN included) of each of the columns, counted in one pass."""
    kinds = dict(rows.dtypes)
    null = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNull()
    one = rows.agg(*[F.count_if(null(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def no_nulls(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, or an error that lists the columns with nulls (this runs a job)."""
    bad = {r.column_name: r.nulls for r in null_counts(rows, columns).collect() if r.nulls}
    if bad:
        raise ValueError(f"nulls in {bad}")
    return rows
