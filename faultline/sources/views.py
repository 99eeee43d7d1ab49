"""Canonical views over the test tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.exprs import NO_PATH

#: What the label-free track must never read.
LABEL = "response"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line, station, value, t: one row for each reading, in long form."""
    line = F.concat(F.lit("L"), (F.col("l_suppkey") % 4).cast("string"))
    station = F.concat(line, F.lit("_S"), (F.col("l_linenumber") % 3 * 5).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), station.alias("station"), F.col("l_quantity").alias("value"),
        F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("t"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part: response, times, mean and path signature; parts without a reading have the sentinel path."""
    r = readings(spark, sf_dir).groupBy("id").agg(
        F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.avg("value").alias("feature_mean"), F.count("value").alias("n_values"),
        F.array_join(F.array_sort(F.collect_set("station")), "|").alias("path_signature"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("response"))
    return o.join(r, "id", "left").select(
        "id", "response", "start_time", "end_time", F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0.0)).alias("duration"),
        F.coalesce("feature_mean", F.lit(0.0)).alias("feature_mean"), F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("path_signature", F.lit(NO_PATH)).alias("path_signature"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, response, q (score in ten-thousandths) and pred."""
    q = F.floor(F.col("o_totalprice") / F.lit(500000.0) * F.lit(10000.0) + F.lit(0.5))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("response"),
        q.cast("int").alias("q"), (q / F.lit(10000.0)).alias("pred"),
    )


def scored3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored with the scores of two more models."""
    return scored(spark, sf_dir).withColumns({"pred_b": F.pmod(F.col("id") * 7919, F.lit(1000)) / F.lit(1000.0), "pred_c": F.pmod(F.col("id") * 104729 + F.col("q"), F.lit(1000)) / F.lit(1000.0)})


#: The same views in SQL for the oracle, as common table expressions.
SQL = {
    "readings": """readings AS (SELECT l_orderkey AS id, 'L' || CAST(l_suppkey % 4 AS VARCHAR) AS line, 'L' || CAST(l_suppkey % 4 AS VARCHAR) || '_S' || CAST(l_linenumber % 3 * 5 AS VARCHAR) AS station,
  l_quantity AS value, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t FROM lineitem)""",
    "parts": """part_readings AS (SELECT id, min(t) AS start_time, max(t) AS end_time, avg(value) AS feature_mean, count(value) AS n_values, string_agg(DISTINCT station, '|' ORDER BY station) AS path_signature FROM readings GROUP BY id),
parts AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) AS response, start_time, end_time, coalesce(end_time - start_time, CAST(0 AS DOUBLE)) AS duration,
  coalesce(feature_mean, CAST(0 AS DOUBLE)) AS feature_mean, coalesce(n_values, 0) AS n_values, coalesce(path_signature, '__none__') AS path_signature FROM orders LEFT JOIN part_readings ON id = o_orderkey)""",
    "scored": """scored AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) AS response,
  CAST(floor(o_totalprice / CAST(500000 AS DOUBLE) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS q, floor(o_totalprice / CAST(500000 AS DOUBLE) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS pred FROM orders)""",
    "scored3": """scored3 AS (SELECT *, CAST(id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pred_b, CAST((id * 104729 + q) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pred_c FROM scored)""",
}
NEEDS = {"parts": ["readings"], "scored3": ["scored"]}


def with_views(body: str, *names: str, more: str = "") -> str:
    """SQL with the named views (and those that they need) in front."""
    chosen: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in chosen:
                chosen.append(x)
    parts_ = [SQL[n] for n in chosen] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts_) + "\n" if parts_ else "") + body


def q6(x: str) -> str:
    """SQL of functions.exprs.quantized."""
    return f"floor(CAST({x} AS DOUBLE) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE)"
