"""Comparisons of experiments, and checks of what experiments leave behind."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import materialize


def durability(arms: DataFrame, base: str) -> DataFrame:
    """arms (arm, incv, oot) with what each gains over the base in cross-validation and out of time, and the share of the gain that lasts, in percent (null without a gain)."""
    b = F.broadcast(arms.where(F.col("arm") == base).select(F.col("incv").alias("__i"), F.col("oot").alias("__o")).limit(1))
    got = arms.join(b).select("arm", "incv", "oot", (F.col("oot") / F.col("incv") * 100).alias("retained_pct"), (F.col("incv") - F.col("__i")).alias("delta_incv"), (F.col("oot") - F.col("__o")).alias("delta_oot"))
    return got.withColumn("durability_pct", F.when(F.abs("delta_incv") > 1e-8, F.col("delta_oot") / F.col("delta_incv") * 100))


def attribution(incv: float, leaky: float, clean: float) -> dict[str, float]:
    """How a fall from cross-validation to a clean split comes about: by the split, and by features made from the past only."""
    return {"split_effect": leaky - incv, "feature_recomputation_effect": clean - leaky, "total_gap": clean - incv}


def rank_change(before: DataFrame, after: DataFrame, name: str = "feature", weight: str = "importance") -> DataFrame:
    """Ranks (by weight, then name) in two tables of few features, and how they change; null where one lacks the feature."""
    def ranks(df: DataFrame, out: str) -> DataFrame:
        return df.select(name, F.row_number().over(Window.orderBy(F.desc(weight), name)).alias(out))

    got = ranks(before, "rank_before").join(ranks(after, "rank_after"), name, "full_outer")
    return got.withColumn("rank_change", F.col("rank_after") - F.col("rank_before"))


def fold_mismatches(rows: DataFrame, recomputed: DataFrame, key: str = "id", fold: str = "cv_fold") -> DataFrame:
    """rows, missing (on either side) and differing folds of two assignments; both counts are 0 if every row is in the same fold once."""
    a, b = rows.select(key, F.col(fold).alias("__a")), recomputed.select(key, F.col(fold).alias("__b"))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a") != F.col("__b")).alias("different"))


@dataclasses.dataclass(frozen=True)
class Policy:
    threshold: float = 0.60
    budget_pct: float = 5.0


def load_policy(path: str | Path) -> Policy:
    """The policy recommended in a summary file; defaults where the file or a value is missing."""
    p = Path(path)
    told = json.loads(p.read_text()).get("final_recommendation", {}) if p.exists() else {}
    return Policy(float(told.get("threshold_high", Policy.threshold)), float(told.get("inspection_budget_pct", Policy.budget_pct)))


#: What a stored model's metadata must hold, as (name, test).
MODEL_CHECKS = (
    ("model_name", lambda v: isinstance(v, str) and v != ""),
    ("feature_cols", lambda v: isinstance(v, Sequence) and not isinstance(v, str) and len(v) > 0 and len(set(v)) == len(v) and all(isinstance(c, str) for c in v)),
    ("threshold", lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1),
    ("oof_mcc", lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and -1 <= v <= 1),
    ("training_rows", lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0),
    ("folds", lambda v: isinstance(v, Sequence) and len(v) > 0 and all(isinstance(f, Mapping) and {"fold", "rows", "threshold", "mcc"} <= f.keys() for f in v)),
)


def model_problems(meta: Mapping) -> list[str]:
    """Names of the checks that the metadata of a stored model fails."""
    return [name for name, ok in MODEL_CHECKS if name not in meta or not ok(meta[name])]


def walk(reports: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, path, parent, name and value (as a string) of every leaf of JSON texts of any depth.

    Names are of the key, or null in a list; a path names keys and places from $ on. Each level of
    all texts is one pass; there are as many as the deepest text has. Texts that aren't JSON, and nulls, have no leaves;
    nor do empty objects and lists.
    """
    spark = reports.sparkSession
    level = materialize(reports.select(*keep, F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL"))
    inner, out = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<"), None
    while True:
        leaves = level.where(~inner).select(*keep, "path", "parent", "name", F.try_variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.union(leaves)
        level = level.where(inner)
        if level.isEmpty():
            return out
        at = level.select(*keep, F.col("path").alias("__path"), "v").withColumnRenamed("v", "__v")
        got = at.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = materialize(got.select(*keep, F.concat("__path", step).alias("path"), F.col("__path").alias("parent"), F.col("key").alias("name"), F.col("value").alias("v")).where("v IS NOT NULL"))


#: Keys that name what a value in a report is of, the first that there is.
NAMED = ("column", "column_name", "metric_name", "name")


def measures(leaves: DataFrame, *keep: str) -> DataFrame:
    """keep, path, name, value, threshold and exceeded of every object of walked reports that has a numeric value."""
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    got = leaves.where("parent IS NOT NULL").groupBy(*keep, F.col("parent").alias("path")).agg(F.coalesce(*map(of, NAMED)).alias("name"), of("value").try_cast("double").alias("value"), of("threshold").try_cast("double").alias("threshold"))
    return got.where("value IS NOT NULL").withColumn("exceeded", F.col("value") > F.col("threshold"))
