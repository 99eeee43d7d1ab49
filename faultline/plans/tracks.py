"""Queries of the label-free and monitoring tracks, of checks, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import boosting
from faultline.operators import evaluate as E
from faultline.operators import joins as J
from faultline.operators.bootstrap import bootstrap_interval
from faultline.operators.drift import drift_report as report_of
from faultline.operators.drift import drift_summary as summary_of
from faultline.operators.drift import drift_table
from faultline.operators.drift import temporal_split as split_of
from faultline.operators.features import filled_start, time_blocks
from faultline.operators.folds import group_folds
from faultline.operators import reports as R
from faultline.operators.feature_pipeline import FeaturePipeline
from faultline.operators.models import oof_predictions, two_stage
from faultline.sources import ingest as I
from faultline.sources import views as V
from faultline.sources.scratch import materialize, shared_dir
from faultline.sources.views import q6, with_views
from faultline.streaming.scorer import score_stream, windowed_counts

from .book import Book
from .decisions import BATCHES, batched, hybrid_sql
from .features import BLOCK, core_features, folded, quantized

Q = Book()

SPLIT = "split AS (SELECT *, row_number() OVER (ORDER BY id) - 1 >= greatest(1, least((SELECT count(*) FROM scored3) * 70 // 100, (SELECT count(*) FROM scored3) - 1)) AS is_current FROM (SELECT *, CAST(pred_b * 1000 + CAST(0.5 AS DOUBLE) AS BIGINT) AS b FROM scored3))"


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored3(spark, sf_dir)
    return split_of(s.withColumn("b", F.pmod(F.col("id") * 7919, F.lit(1000))), "id")


@Q.query(with_views(f"SELECT is_current, count(*) AS n, min(id) AS first_id, {q6('avg(q) / 10000')} AS mean_score FROM split GROUP BY 1", "scored3", more=SPLIT))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(split(spark, sf_dir).groupBy("is_current").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), (F.avg("q") / 10000).alias("mean_score")), "mean_score")


def distance_sql(column: str) -> str:
    return f"""(SELECT sum(gap * coalesce(step, 0)) / CAST(10000 AS DOUBLE) AS w, max(gap) AS ks, sqrt(sum(a * CAST(v AS DOUBLE) * v) / sum(a) - (sum(a * CAST(v AS DOUBLE)) / sum(a)) * (sum(a * CAST(v AS DOUBLE)) / sum(a))) / CAST(10000 AS DOUBLE) AS s FROM (
  SELECT v, a, abs(CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(a) OVER () AS DOUBLE) - CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(b) OVER () AS DOUBLE)) AS gap, lead(v) OVER (ORDER BY v) - v AS step
  FROM (SELECT {column} AS v, count(*) FILTER (WHERE NOT is_current) AS a, count(*) FILTER (WHERE is_current) AS b FROM split GROUP BY 1)))"""


DRIFT = "drift AS (" + " UNION ALL ".join(f"SELECT '{n}' AS column_name, {q6('w / s')} AS distance, {q6('ks')} AS ks, w / s > 0.1 AS drifted FROM {distance_sql(c)}" for n, c in (("q", "q"), ("b", "CAST(id * 7919 % 1000 AS INTEGER)"))) + ")"


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split(spark, sf_dir)
    return drift_table(s.where("NOT is_current"), s.where("is_current"), ["q", "b", "batch_id"])


@Q.query(with_views("SELECT column_name, distance, drifted FROM drift", "scored3", more=SPLIT + ", " + DRIFT))
def drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(drift(spark, sf_dir), "distance").select("column_name", "distance", "drifted")


@Q.query(with_views("SELECT column_name, ks FROM drift", "scored3", more=SPLIT + ", " + DRIFT))
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(drift(spark, sf_dir), "ks").select("column_name", "ks")


@Q.query(with_views("SELECT count(*) FILTER (WHERE column_name <> 'q') AS columns, count(*) FILTER (WHERE column_name <> 'q' AND drifted) AS drifted_columns, CAST(count(*) FILTER (WHERE column_name <> 'q' AND drifted) AS DOUBLE) / CAST(count(*) FILTER (WHERE column_name <> 'q') AS DOUBLE) AS share, max(distance) FILTER (WHERE column_name = 'q') AS score_distance, CAST(max(CAST(drifted AS INTEGER)) FILTER (WHERE column_name = 'q') AS INTEGER) AS score_drifted FROM drift", "scored3", more=SPLIT + ", " + DRIFT))
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_of(quantized(drift(spark, sf_dir), "distance"))


#: Columns of line items that are compared between those shipped early and late, with their SQL.
NUMBERS = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORIES = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "line": "'L' || CAST(l_suppkey % 4 AS VARCHAR)", "month": "substr(CAST(l_shipdate AS VARCHAR), 1, 7)", "taxed": "CASE WHEN l_tax > 0.04 THEN l_returnflag END", "discounted": "CAST(l_discount > 0.05 AS VARCHAR)"}
ITEMS = f"split AS (SELECT {', '.join(NUMBERS)}, {', '.join(f'{v} AS {k}' for k, v in CATEGORIES.items() if k != v)}, l_returnflag, l_linestatus, l_shipdate >= TIMESTAMP '1997-01-01' AS is_current FROM lineitem)"


def _category_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, 'category' AS kind, {q6('sqrt(greatest(0, sum(js)))')} AS distance, CAST(NULL AS DOUBLE) AS ks, {q6('sum(square)')} AS chi_square, count(*) - 1 AS degrees, count(*) FILTER (WHERE a = 0) AS unseen, sqrt(greatest(0, sum(js))) > 0.1 AS drifted FROM (
  SELECT a, (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js, (a - na * m) * (a - na * m) / (na * m) + (b - nb * m) * (b - nb * m) / (nb * m) AS square FROM (
    SELECT a, b, na, nb, CAST(a AS DOUBLE) / na AS p, CAST(b AS DOUBLE) / nb AS q, CAST(a + b AS DOUBLE) / (na + nb) AS m FROM (
      SELECT a, b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (SELECT count(*) FILTER (WHERE NOT is_current) AS a, count(*) FILTER (WHERE is_current) AS b FROM split GROUP BY {c}))))"""


@Q.query(f"WITH {ITEMS} " + " UNION ALL ".join([*(f"SELECT '{c}' AS column_name, 'numeric' AS kind, {q6('w / s')} AS distance, {q6('ks')} AS ks, CAST(NULL AS DOUBLE) AS chi_square, CAST(NULL AS BIGINT) AS degrees, CAST(NULL AS BIGINT) AS unseen, w / s > 0.1 AS drifted FROM {distance_sql(c)}" for c in NUMBERS), *map(_category_sql, CATEGORIES)]))
def drift_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of thirteen columns, numbers and categories, in one pass over each table."""
    t = V.table(spark, sf_dir, "lineitem")
    made = {"line": F.concat(F.lit("L"), (F.col("l_suppkey") % 4).cast("string")), "month": F.date_format("l_shipdate", "yyyy-MM"), "taxed": F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")), "discounted": F.col("l_discount") > 0.05}
    rows = t.withColumns(made).select(*NUMBERS, *CATEGORIES, (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).alias("is_current"))
    return quantized(report_of(rows.where("NOT is_current").drop("is_current"), rows.where("is_current").drop("is_current")), "distance", "ks", "chi_square")


PRODUCTION = f"SELECT batch_id, id, q, auto_reject, manual_inspect, decision FROM ({hybrid_sql(9200, 10.0, 'batch_id')})"


@Q.query(with_views(PRODUCTION, "scored", more=BATCHES))
def production_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid policy on batches without labels."""
    return E.hybrid(J.refuse(batched(spark, sf_dir, label=False), V.LABEL), 9200, 10.0, "batch_id").select("batch_id", "id", "q", "auto_reject", "manual_inspect", "decision")


@Q.query(with_views(f"SELECT batch_id, n, flagged, {q6('100 * flagged / CAST(n AS DOUBLE)')} AS flagged_pct, first_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS cumulative_rows FROM (SELECT batch_id, count(*) AS n, CAST(sum(decision) AS BIGINT) AS flagged, min(id) AS first_id FROM ({PRODUCTION}) GROUP BY 1)", "scored", more=BATCHES))
def batch_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.operators.ordered import running

    by = production_batches(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("decision").alias("flagged"), F.min("id").alias("first_id"))
    got = running(by, [F.col("batch_id")], {"cumulative_rows": F.col("n")}, None)
    return quantized(got.withColumn("flagged_pct", 100 * F.col("flagged") / F.col("n").cast("double")), "flagged_pct")


@Q.query(with_views("SELECT id, q, pred FROM scored ORDER BY q DESC, id LIMIT 100", "scored"))
def top_risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scored(spark, sf_dir).select("id", "q", "pred").orderBy(F.desc("q"), "id").limit(100)  # the report is the top 100


@Q.query("SELECT 'missing' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'extra', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def id_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return J.id_difference(V.readings(spark, sf_dir).select("id"), orders, "id")


@Q.query(with_views("SELECT 'left' AS side, count(*) AS keys, count(*) FILTER (WHERE c > 1) AS repeated_keys FROM (SELECT count(*) AS c FROM parts GROUP BY id) UNION ALL SELECT 'right', count(*), count(*) FILTER (WHERE c > 1) FROM (SELECT count(*) AS c FROM readings GROUP BY id)", "parts"))
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.key_repeats(V.parts(spark, sf_dir), V.readings(spark, sf_dir), "id")


#: Fixed cases of manifests: (manifest, file, action, sample, rows, rows on record of an earlier sample).
@Q.query(with_views("SELECT id, CASE WHEN run_size > 1 THEN pred_b ELSE pred END AS pred FROM (SELECT id, pred, pred_b, count(*) OVER (PARTITION BY path_signature) AS run_size FROM scored3 JOIN (SELECT id, path_signature FROM parts) USING (id))", "scored3", "parts"))
def two_stage_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second model's score for parts that share their path with others."""
    p = V.parts(spark, sf_dir).select("id", "path_signature")
    sizes = p.groupBy("path_signature").agg(F.count("*").alias("run_size"))
    rows = V.scored3(spark, sf_dir).join(p.join(sizes, "path_signature"), "id")
    return two_stage(rows.withColumnRenamed("pred", "first"), "first", "pred_b").select("id", "pred")


@Q.query(with_views("SELECT id, pred AS score, CASE WHEN q >= 9100 THEN 'auto_reject' ELSE 'pass' END AS action FROM scored", "scored"))
def predict_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.predict_actions(V.scored(spark, sf_dir), 0.91).select("id", F.col("pred").alias("score"), "action")


@Q.query("SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, " + q6("sum(value)") + " AS value FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly counts of events."""
    return quantized(windowed_counts(V.table(spark, sf_dir, "events")), "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Groups dealt one after the other, most positives first, to the fold that is then the most even: lists of what the folds have.
DEALT = f"""filled AS (SELECT * REPLACE (coalesce(start_time, min(start_time) OVER () - 1) AS start_time) FROM parts),
counts AS (SELECT g, sum(response) AS pos, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY start_time, id) - 1) // {BLOCK} AS g, response FROM filled) GROUP BY g),
blocks AS (SELECT row_number() OVER (ORDER BY pos DESC, n DESC, g) AS k, CAST(pos AS BIGINT) AS pos, n, CAST(greatest(1, sum(pos) OVER ()) AS DOUBLE) AS p, CAST(greatest(1, sum(n) OVER ()) AS DOUBLE) AS m FROM counts),
dealt AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS hp, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS hn UNION ALL
  SELECT k, fold, list_transform(hp, lambda x, i: x + CASE WHEN i = fold THEN pos ELSE 0 END), list_transform(hn, lambda x, i: x + CASE WHEN i = fold THEN n ELSE 0 END) FROM (
    SELECT k, hp, hn, pos, n, CAST(list_position(s, list_min(s)) AS INTEGER) AS fold FROM (
      SELECT b.k, hp, hn, b.pos, b.n, list_transform(hp, lambda x, i: (x + b.pos) / b.p + (hn[i] + b.n) / b.m) AS s FROM dealt d JOIN blocks b ON b.k = d.k + 1)))"""


@Q.query(with_views("SELECT CAST(fold - 1 AS INTEGER) AS cv_fold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, count(*) AS blocks FROM blocks JOIN dealt USING (k) GROUP BY 1", "parts", more=DEALT).replace("WITH ", "WITH RECURSIVE ", 1))
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole time blocks."""
    parts = filled_start(V.parts(spark, sf_dir)).select("id", "response", "start_time")
    rows = group_folds(time_blocks(parts, BLOCK), "time_block", "response", 5)
    return rows.groupBy("cv_fold").agg(F.count("*").alias("n"), F.sum("response").alias("pos"), F.countDistinct("time_block").alias("blocks"))


MODEL = ("start_time", "duration", "feature_mean", "records_last_1hr", "records_last_24hr", "density_ratio")
#: Steps are larger than the operator's own, and patience shorter, so that small tables are done in some ten rounds; there is no other end of rounds.
GBT = boosting.Params(rate=0.3, depth=3, patience=5)


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core features with five folds of whole time blocks."""
    return materialize(group_folds(core_features(spark, sf_dir), "time_block", "response", 5))


@Q.query()
def gbt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of boosted trees on the core features, five folds of whole time blocks."""
    return oof_predictions(dealt_parts(spark, sf_dir), MODEL, params=GBT)[0]


@Q.query()
def stored_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decisions of all parts by fold models that were stored and loaded again, without labels; `same` compares them with the scores before."""
    rows = dealt_parts(spark, sf_dir)
    path = shared_dir(spark)
    models = boosting.described(boosting.fit(rows, MODEL, params=GBT), rows, "core")
    boosting.save(models, spark, path)
    loaded = boosting.load(spark, path, MODEL)
    unlabelled = rows.drop(V.LABEL)
    before = boosting.scores(models, unlabelled, "id", name="before")
    got = boosting.scores(loaded, unlabelled, "id").join(before, "id")
    return got.select("id", "pred", (F.col("pred") >= loaded.meta["threshold"]).cast("int").alias("decision"), (F.col("pred") == F.col("before")).alias("same"))


@Q.query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_interval(V.scored(spark, sf_dir))


@Q.query(with_views("SELECT count(*) AS n, CAST(sum(auto_reject) AS BIGINT) AS autos, CAST(sum(decision) AS BIGINT) AS flagged FROM (" + hybrid_sql(9200, 10.0, "batch_id") + ")", "scored", more="rows AS (SELECT *, id % 4 AS batch_id FROM scored)"))
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files come one by one; each is a micro-batch of the label-free scorer."""
    base = shared_dir(spark)
    s = V.scored(spark, sf_dir).drop(V.LABEL)
    for k in range(4):
        s.where(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    got = I.read_partitions(spark, f"{base}/out")
    return got.agg(F.count("*").alias("n"), F.sum("auto_reject").alias("autos"), F.sum("decision").alias("flagged"))


@Q.query("SELECT feature, CAST(a.r AS INTEGER) AS rank_before, CAST(b.r AS INTEGER) AS rank_after, CAST(b.r - a.r AS INTEGER) AS rank_change FROM (SELECT n_name AS feature, row_number() OVER (ORDER BY n_nationkey % 7 DESC, n_name) AS r FROM nation) a FULL JOIN (SELECT n_name AS feature, row_number() OVER (ORDER BY n_nationkey % 5 DESC, n_name) AS r FROM nation) b USING (feature)")
def importance_rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation")
    side = lambda m: n.select(F.col("n_name").alias("feature"), (F.col("n_nationkey") % m).alias("importance"))
    return R.rank_change(side(7), side(5))


@Q.query()
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on each half of the parts, applied to the other half with the first as context."""
    parts, out = materialize(V.parts(spark, sf_dir)), None
    halves = [materialize(parts.where(F.col("id") % 2 == k)) for k in range(2)]
    for known, others in (halves, halves[::-1]):
        got = FeaturePipeline.fit(known, numeric=["n_values"], categorical=["path_signature"]).transform(others, known)
        out = got if out is None else out.unionByName(got)
    return out


@Q.query(with_views("SELECT state, count(*) AS rows, CASE state WHEN 'broken' THEN count(*) FILTER (WHERE id % 101 = 3) ELSE 0 END AS missing, CASE state WHEN 'broken' THEN count(*) FILTER (WHERE id % 97 = 5 AND id % 101 <> 3) ELSE 0 END AS different FROM parts, (VALUES ('kept'), ('broken')) s(state) GROUP BY state", "parts"))
def fold_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored folds against folds computed anew: as they were stored, and with some rows lost and some moved to another fold."""
    stored = materialize(folded(spark, sf_dir).select("id", "cv_fold"))
    broken = stored.where("id % 101 <> 3").withColumn("cv_fold", F.when(F.col("id") % 97 == 5, (F.col("cv_fold") + 1) % 5).otherwise(F.col("cv_fold")))
    now = folded(spark, sf_dir).select("id", "cv_fold")
    kept = R.fold_mismatches(now, stored).withColumn("state", F.lit("kept"))
    return kept.unionByName(R.fold_mismatches(now, broken).withColumn("state", F.lit("broken")))
