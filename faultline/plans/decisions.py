"""Decision queries: sweeps, budgets, costs, policies, ranking and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import exprs as X
from faultline.operators import evaluate as E
from faultline.operators.ordered import running
from faultline.sources import views as V
from faultline.sources.views import q6, with_views

from .book import Book
from .features import BLOCK, PATH_COLUMNS, path_sql, quantized

Q = Book()
D = "CAST({} AS DOUBLE)".format
BATCH = 1000
THRESHOLD, BUDGET = 6000, 5.0


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE {D(a)} / {D(b)} END"


def mcc_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> str:
    d = f"({D(tp)} + {D(fp)}) * ({D(tp)} + {D(fn)}) * ({D(tn)} + {D(fp)}) * ({D(tn)} + {D(fn)})"
    return f"CASE WHEN {d} <= 0 THEN CAST(0 AS DOUBLE) ELSE ({D(tp)} * {D(tn)} - {D(fp)} * {D(fn)}) / sqrt({d}) END"


#: Metrics of counts, as evaluate.with_metrics has them.
METRICS = f"{q6(ratio_sql('tp', 'tp + fp'))} AS precision, {q6(ratio_sql('tp', 'tp + fn'))} AS recall, {q6(mcc_sql())} AS mcc, {q6('100 * ' + ratio_sql('tp + fp', 'tp + fp + fn + tn'))} AS positives_pct"
COUNTS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn"
NAMES = ("precision", "recall", "mcc", "positives_pct")
SWEEP = f"""counts AS (SELECT i / CAST(100 AS DOUBLE) AS threshold, count(*) FILTER (WHERE q >= 100 * i AND response = 1) AS tp, count(*) FILTER (WHERE q >= 100 * i AND response = 0) AS fp,
  count(*) FILTER (WHERE q < 100 * i AND response = 1) AS fn, count(*) FILTER (WHERE q < 100 * i AND response = 0) AS tn FROM scored, range(1, 100) g(i) GROUP BY i),
sweep AS (SELECT threshold, {COUNTS}, {METRICS} FROM counts)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY q DESC, id) AS rank FROM scored)"
CURVE = f"""curve AS (SELECT inspection_budget_pct, selected_rows, score_cutoff, {COUNTS}, {METRICS} FROM (
  SELECT CAST(p AS DOUBLE) AS inspection_budget_pct, k AS selected_rows, coalesce(min(q), 10000) / CAST(10000 AS DOUBLE) AS score_cutoff, coalesce(sum(response), 0) AS tp, k - coalesce(sum(response), 0) AS fp,
    (SELECT sum(response) FROM scored) - coalesce(sum(response), 0) AS fn, (SELECT count(*) FROM scored) - (SELECT sum(response) FROM scored) - k + coalesce(sum(response), 0) AS tn
  FROM (SELECT p, (p * (SELECT count(*) FROM scored) + 99) // 100 AS k FROM range(1, 11) g(p)) LEFT JOIN ranked ON rank <= k GROUP BY p, k))"""


def measured(df: DataFrame) -> DataFrame:
    return quantized(df, *NAMES)


@Q.query(with_views("SELECT * FROM sweep", "scored", more=SWEEP))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(E.threshold_sweep(V.scored(spark, sf_dir)))


@Q.query(with_views("SELECT * FROM sweep ORDER BY mcc DESC, threshold LIMIT 1", "scored", more=SWEEP))
def best_mcc_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(E.best_threshold(V.scored(spark, sf_dir)))


@Q.query(with_views("SELECT * FROM curve", "scored", more=RANKED + ", " + CURVE))
def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(E.budget_curve(V.scored(spark, sf_dir)))


COST = "CAST(fn * 100 + fp * 5 AS DOUBLE)"
DECISIONS = f"""decisions AS (SELECT 'threshold' AS source, printf('thr=%.2f', threshold) AS configuration, threshold, {', '.join(NAMES)}, tp, fp, fn, tn FROM sweep
UNION ALL SELECT 'budget', printf('budget=%d%%', CAST(inspection_budget_pct AS INTEGER)), score_cutoff, {', '.join(NAMES)}, tp, fp, fn, tn FROM curve),
costs AS (SELECT *, {COST} AS total_cost, {q6(f'{COST} / CAST(tp + fp + fn + tn AS DOUBLE) * CAST(100000 AS DOUBLE)')} AS cost_per_100k_rows FROM decisions)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold and budget with its cost."""
    s = V.scored(spark, sf_dir)
    a = threshold_sweep(spark, sf_dir).select(F.lit("threshold").alias("source"), F.format_string("thr=%.2f", "threshold").alias("configuration"), "threshold", *NAMES, "tp", "fp", "fn", "tn")
    b = measured(E.budget_curve(s)).select(F.lit("budget").alias("source"), F.format_string("budget=%d%%", F.col("inspection_budget_pct").cast("int")).alias("configuration"), F.col("score_cutoff").alias("threshold"), *NAMES, "tp", "fp", "fn", "tn")
    return quantized(E.cost_table(a.unionByName(b)), "cost_per_100k_rows")


@Q.query(with_views("SELECT * FROM costs", "scored", more=", ".join((SWEEP, RANKED, CURVE, DECISIONS))))
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir)


def _point(name: str, where: str, order: str) -> str:
    return f"(SELECT '{name}' AS category, * FROM balanced WHERE {where} ORDER BY {order}, configuration LIMIT 1)"


@Q.query(with_views("SELECT n.category, source, configuration, threshold, precision, recall, mcc, positives_pct, tp, fp, fn, tn, total_cost, cost_per_100k_rows, threshold IS NOT NULL AS available FROM (VALUES ('min_cost'), ('best_recall_1pct'), ('best_recall_5pct'), ('best_recall_10pct'), ('best_balance')) n(category) LEFT JOIN (" + " UNION ALL ".join([
    _point("min_cost", "true", "total_cost, recall DESC, threshold"), *[_point(f"best_recall_{b}pct", f"positives_pct <= {b}", "recall DESC, precision DESC, threshold") for b in (1, 5, 10)], _point("best_balance", "true", "balance_score DESC, mcc DESC, threshold")]) + ") USING (category)", "scored",
    more=", ".join((SWEEP, RANKED, CURVE, DECISIONS, f"balanced AS (SELECT *, {q6('2 * precision * recall / (precision + recall + CAST(1e-12 AS DOUBLE))')} AS balance_score FROM costs)"))))
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.operating_points(decisions(spark, sf_dir)).drop("balance_score")


@Q.query(with_views("SELECT target, threshold, precision, recall, threshold IS NOT NULL AS available FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY recall DESC, precision DESC, threshold) AS r FROM (SELECT CAST(k * 5 AS DOUBLE) / CAST(100 AS DOUBLE) AS target FROM range(1, 11) g(k)) LEFT JOIN sweep ON precision >= target) WHERE r = 1", "scored", more=SWEEP))
def recall_at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_at_precision(threshold_sweep(spark, sf_dir), [k * 5 / 100 for k in range(1, 11)]).select("target", "threshold", "precision", "recall", "available")


@Q.query(with_views(f"""SELECT CASE WHEN q >= h THEN 'HIGH' WHEN q >= m THEN 'MEDIUM' ELSE 'LOW' END AS risk_group, count(*) AS n, {q6('avg(response) * 100')} AS failure_pct, {q6('avg(q) / 10000')} AS mean_score
FROM scored, (SELECT quantile_cont(CAST(q AS DOUBLE), 0.9) AS h, quantile_cont(CAST(q AS DOUBLE), 0.7) AS m FROM scored) GROUP BY 1""", "scored"))
def risk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    m, h = s.agg(F.percentile(F.col("q").cast("double"), F.array(F.lit(0.7), F.lit(0.9))).alias("x")).first().x
    group = F.when(F.col("q") >= h, "HIGH").when(F.col("q") >= m, "MEDIUM").otherwise("LOW")
    return quantized(s.groupBy(group.alias("risk_group")).agg(F.count("*").alias("n"), (F.avg("response") * 100).alias("failure_pct"), (F.avg("q") / 10000).alias("mean_score")), "failure_pct", "mean_score")


@Q.query(with_views(f"SELECT id, CAST(q >= {THRESHOLD} AS INTEGER) AS decision FROM scored", "scored"))
def threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scored(spark, sf_dir).select("id", (F.col("q") >= THRESHOLD).cast("int").alias("decision"))


@Q.query(with_views("SELECT id, CAST(rank <= (5 * (SELECT count(*) FROM scored) + 99) // 100 AS INTEGER) AS decision FROM ranked", "scored", more=RANKED))
def topk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_k(V.scored(spark, sf_dir), 5.0).select("id", "decision")


def hybrid_sql(threshold: int, percent: float, by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, greatest(auto_reject, manual_inspect) AS decision FROM (SELECT *, CAST(auto_reject = 0 AND r <= greatest(0, room) AS INTEGER) AS manual_inspect FROM (
  SELECT *, row_number() OVER (PARTITION BY {by + ',' if by else ''} auto_reject ORDER BY q DESC, id) AS r, CAST(ceil(count(*) OVER ({over}) * {D(percent)} / CAST(100 AS DOUBLE)) AS BIGINT) - sum(auto_reject) OVER ({over}) AS room
  FROM (SELECT *, CAST(q >= {threshold} AS INTEGER) AS auto_reject FROM rows)))"""


@Q.query(with_views(f"SELECT id, auto_reject, manual_inspect, decision FROM ({hybrid_sql(9200, 10.0)})", "scored", more="rows AS (SELECT * FROM scored)"))
def hybrid_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hybrid(V.scored(spark, sf_dir), 9200, 10.0).select("id", "auto_reject", "manual_inspect", "decision")


BATCHES = f"rows AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // {BATCH} AS batch_id FROM scored)"
REPLAY = f"""replay AS (SELECT batch_id, {COUNTS}, {METRICS}, {q6('m')} AS pred_mean, {q6('s')} AS pred_std FROM (SELECT batch_id, count(*) FILTER (WHERE decision = 1 AND response = 1) AS tp, count(*) FILTER (WHERE decision = 1 AND response = 0) AS fp,
  count(*) FILTER (WHERE decision = 0 AND response = 1) AS fn, count(*) FILTER (WHERE decision = 0 AND response = 0) AS tn, avg(q) / 10000 AS m, stddev_pop(q) / 10000 AS s FROM ({hybrid_sql(9200, 10.0, 'batch_id')}) GROUP BY batch_id))"""


def batched(spark: SparkSession, sf_dir: str, label: bool = True) -> DataFrame:
    s = V.scored(spark, sf_dir)
    got = running(s, [F.col("id")]).withColumn("batch_id", F.floor(F.col("pos") / BATCH)).drop("pos")
    return got if label else got.drop(V.LABEL)


@Q.query(with_views("SELECT * FROM replay", "scored", more=BATCHES + ", " + REPLAY))
def batch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid policy inside each batch, with metrics and scores of the batch."""
    got = E.hybrid(batched(spark, sf_dir), 9200, 10.0, "batch_id")
    y, d, n = F.col("response") == 1, F.col("decision") == 1, F.col("q")
    got = got.groupBy("batch_id").agg(F.count_if(y & d).alias("tp"), F.count_if(~y & d).alias("fp"), F.count_if(y & ~d).alias("fn"), F.count_if(~y & ~d).alias("tn"), (F.avg(n) / 10000).alias("pred_mean"), (F.stddev_pop(n) / 10000).alias("pred_std"))
    return quantized(measured(E.with_metrics(got)), "pred_mean", "pred_std")


@Q.query(with_views("SELECT " + ", ".join(f"{q6(f'avg({c})')} AS {c}_mean, {q6(f'stddev_samp({c})')} AS {c}_std" for c in ("precision", "recall", "mcc")) + ", count(*) AS batches FROM replay", "scored", more=BATCHES + ", " + REPLAY))
def batch_replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for c in ("precision", "recall", "mcc") for n in (f"{c}_mean", f"{c}_std")]
    aggs = [f(c).alias(f"{c}_{n}") for c in ("precision", "recall", "mcc") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return quantized(batch_replay(spark, sf_dir).agg(*aggs, F.count("*").alias("batches")), *names)


@Q.query(with_views(f"""SELECT {q6('u / (CAST(p AS DOUBLE) * CAST(n - p AS DOUBLE))')} AS auc FROM (SELECT sum((n - pos) * (tp - pos / CAST(2 AS DOUBLE))) AS u, sum(pos) AS p, sum(n) AS n FROM (SELECT q, n, pos, sum(pos) OVER (ORDER BY q DESC) AS tp FROM
  (SELECT q, count(*) AS n, sum(response) AS pos FROM scored GROUP BY q)))""", "scored"))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(E.roc_auc(V.scored(spark, sf_dir)).select("auc"), "auc")


@Q.query(with_views(f"""SELECT {q6('s / p')} AS average_precision, {q6('p / n')} AS prevalence, {q6('(s / p) / (p / n)')} AS lift FROM (SELECT sum(pos * (CAST(tp AS DOUBLE) / CAST(m AS DOUBLE))) AS s, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n FROM
  (SELECT *, sum(pos) OVER (ORDER BY q DESC) AS tp, sum(n) OVER (ORDER BY q DESC) AS m FROM (SELECT q, count(*) AS n, sum(response) AS pos FROM scored GROUP BY q)))""", "scored"))
def avg_precision_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(E.average_precision(V.scored(spark, sf_dir)), "average_precision", "prevalence", "lift")


@Q.query(with_views(f"""SELECT CAST(m AS DOUBLE) / CAST(10 AS DOUBLE) AS top_pct, k, CAST(sum(response) AS BIGINT) AS tp, {q6('sum(response) / CAST(k AS DOUBLE)')} AS precision, {q6('sum(response) / CAST((SELECT sum(response) FROM scored) AS DOUBLE)')} AS recall,
  {q6('(sum(response) / CAST(k AS DOUBLE)) / (SELECT avg(response) FROM scored)')} AS lift FROM (SELECT m, greatest(1, ((SELECT count(*) FROM scored) * m + 999) // 1000) AS k FROM (VALUES (1), (5), (10)) g(m)) JOIN ranked ON rank <= k GROUP BY m, k""", "scored", more=RANKED))
def topk_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(E.top_lift(V.scored(spark, sf_dir), [1, 5, 10]), "precision", "recall", "lift")


@Q.query(with_views(f"SELECT CAST(greatest(0, least(9, ceil(q / CAST(1000 AS DOUBLE)) - 1)) AS INTEGER) AS bin, count(*) AS n, {q6('avg(q) / 10000')} AS mean_score, {q6('avg(response)')} AS positive_rate FROM scored GROUP BY 1", "scored"))
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(E.calibration(V.scored(spark, sf_dir)), "mean_score", "positive_rate")


@Q.query(with_views(f"SELECT {q6('avg(CAST((10000 * response - q) AS DOUBLE) * (10000 * response - q)) / CAST(100000000 AS DOUBLE)')} AS brier, count(*) AS n FROM scored", "scored"))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(E.brier(V.scored(spark, sf_dir)), "brier")


CEILING = {"fixed_0.91": "SELECT id, response, CAST(q >= 9100 AS INTEGER) AS decision FROM scored", "oracle": "SELECT id, response, CAST(q >= 10000 * (SELECT threshold FROM sweep ORDER BY mcc DESC, threshold LIMIT 1) AS INTEGER) AS decision FROM scored", "hybrid_0.60_10": f"SELECT id, response, decision FROM ({hybrid_sql(6000, 10.0)})"}


@Q.query(with_views(f"SELECT mode, {COUNTS}, {METRICS}, {COST} AS total_cost FROM (SELECT mode, count(*) FILTER (WHERE decision = 1 AND response = 1) AS tp, count(*) FILTER (WHERE decision = 1 AND response = 0) AS fp, count(*) FILTER (WHERE decision = 0 AND response = 1) AS fn, count(*) FILTER (WHERE decision = 0 AND response = 0) AS tn FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS mode, * FROM ({v})" for k, v in CEILING.items()) + ") GROUP BY mode)", "scored", more=SWEEP + ", rows AS (SELECT * FROM scored)"))
def decision_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir)
    best = E.best_threshold(s).first().threshold
    hybrid = E.hybrid(s, 6000, 10.0)
    out = None
    for name, rows, d in (("fixed_0.91", s, F.col("q") >= 9100), ("oracle", s, F.col("q") >= round(best * 10000)), ("hybrid_0.60_10", hybrid, F.col("decision") == 1)):
        got = E.confusion(rows, d.cast("int")).withColumn("mode", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return measured(E.with_metrics(out)).withColumn("total_cost", X.cost(F.col("fp"), F.col("fn")).cast("double"))


@Q.query(with_views(f"""SELECT k, neg, pos, CAST(floor(neg * pi / (1 - pi) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS need, CASE WHEN neg = 0 OR pos = 0 THEN 'one_class' WHEN floor(neg * pi / (1 - pi) + CAST(0.5 AS DOUBLE)) < 1 THEN 'none_left' WHEN floor(neg * pi / (1 - pi) + CAST(0.5 AS DOUBLE)) > pos THEN 'too_few' ELSE 'feasible' END AS status
FROM (SELECT CAST(id % 5 AS INTEGER) AS k, count(*) FILTER (WHERE response = 0) AS neg, count(*) FILTER (WHERE response = 1) AS pos FROM scored GROUP BY 1), (SELECT CAST(sum(response) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pi FROM scored WHERE id % 5 = 0)""", "scored"))
def prevalence_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each fold has the positives that the prevalence of fold 0 asks for, its negatives kept."""
    s = V.scored(spark, sf_dir).withColumn("k", (F.col("id") % 5).cast("int"))
    pi = s.where("k = 0").agg(F.sum("response") / F.count("*").cast("double")).first()[0]
    got = s.groupBy("k").agg(F.count_if(F.col("response") == 0).alias("neg"), F.count_if(F.col("response") == 1).alias("pos"))
    got = got.withColumn("need", F.floor(F.col("neg") * F.lit(pi) / F.lit(1 - pi) + F.lit(0.5)))
    return got.withColumn("status", F.when((F.col("neg") == 0) | (F.col("pos") == 0), "one_class").when(F.col("need") < 1, "none_left").when(F.col("need") > F.col("pos"), "too_few").otherwise("feasible"))


ORIGINS = 5


@Q.query(with_views(" UNION ALL ".join(f"SELECT {k} AS fold_idx, id, f{k}.* FROM (SELECT * FROM blocked WHERE part = {k}) JOIN f{k} USING (path_signature)" for k in range(1, ORIGINS + 1)), "parts",
    more="filled AS (SELECT * REPLACE (coalesce(start_time, min(start_time) OVER () - 1) AS start_time) FROM parts), " + f"blocked AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY start_time, id) - 1) * {ORIGINS + 1} / (SELECT count(*) FROM parts)) AS INTEGER) AS part FROM filled)" + "".join("," + path_sql(f"(SELECT * FROM blocked WHERE part < {k})", f"(SELECT * FROM blocked WHERE part = {k})", f"(SELECT avg(response) FROM blocked WHERE part < {k})", str(k)) for k in range(1, ORIGINS + 1))))
def rolling_origin_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path features of each window of time from all windows before it only."""
    from faultline.operators import features as ops

    rows = ops.filled_start(V.parts(spark, sf_dir))
    n = rows.count()
    rows = running(rows, [F.col("start_time"), F.col("id")]).withColumn("part", F.floor(F.col("pos") * (ORIGINS + 1) / n).cast("int")).select("id", "part", "path_signature", "response")
    out = None
    for k in range(1, ORIGINS + 1):  # expanding windows: each learns from another set of rows
        train = rows.where(F.col("part") < k)
        overall = train.agg(F.avg("response")).first()[0]
        got = ops.path_features(rows.where(F.col("part") == k).select("id", "path_signature"), ops.path_lookup(train), overall).withColumn("fold_idx", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return quantized(out, *PATH_COLUMNS)


@Q.query(with_views(f"SELECT CAST(time_block % 5 AS INTEGER) AS cv_fold, count(*) AS n, CAST(sum(response) AS BIGINT) AS pos, {q6('avg(response)')} AS rate FROM (SELECT response, (row_number() OVER (ORDER BY start_time, id) - 1) // {BLOCK} AS time_block FROM (SELECT * REPLACE (coalesce(start_time, min(start_time) OVER () - 1) AS start_time) FROM parts)) GROUP BY 1", "parts"))
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .features import folded

    return quantized(folded(spark, sf_dir).groupBy("cv_fold").agg(F.count("*").alias("n"), F.sum("response").alias("pos"), F.avg("response").alias("rate")), "rate")


@Q.query(with_views(f"SELECT id, {q6('(pred + pred_b + pred_c) / 3')} AS mean, {q6('sqrt(greatest(0, (pred * pred + pred_b * pred_b + pred_c * pred_c) / 3 - ((pred + pred_b + pred_c) / 3) * ((pred + pred_b + pred_c) / 3)))')} AS std, greatest(pred, pred_b, pred_c) AS max, CAST(pred >= 0.5 AS INTEGER) + CAST(pred_b >= 0.9 AS INTEGER) + CAST(pred_c >= 0.91 AS INTEGER) AS agreement FROM scored3", "scored3"))
def meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and maximum of three models' scores, and how many reach their thresholds."""
    a, b, c = F.col("pred"), F.col("pred_b"), F.col("pred_c")
    m = (a + b + c) / 3
    std = F.sqrt(F.greatest(F.lit(0.0), (a * a + b * b + c * c) / 3 - m * m))
    got = V.scored3(spark, sf_dir).select("id", m.alias("mean"), std.alias("std"), F.greatest(a, b, c).alias("max"), ((a >= 0.5).cast("int") + (b >= 0.9).cast("int") + (c >= 0.91).cast("int")).alias("agreement"))
    return quantized(got, "mean", "std")


@Q.query(with_views("SELECT id, q, CASE WHEN response = 1 AND q >= 6000 THEN 'TP' ELSE 'FN' END AS segment FROM scored WHERE response = 1", "scored"))
def confusion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir).where("response = 1")
    return s.select("id", "q", F.when(F.col("q") >= THRESHOLD, "TP").otherwise("FN").alias("segment"))


@Q.query(with_views(f"SELECT count(*) AS n, {q6('avg(q) / 10000')} AS mean, {q6('stddev_pop(q) / 10000')} AS std, min(q) / CAST(10000 AS DOUBLE) AS min, " + ", ".join(f"{q6(f'quantile_cont(CAST(q AS DOUBLE), {p}) / 10000')} AS p{str(p)[2:].ljust(2, '0')}" for p in (0.1, 0.5, 0.9, 0.99)) + ", max(q) / CAST(10000 AS DOUBLE) AS max FROM scored", "scored"))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    p = F.percentile(q.cast("double"), F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.99))))
    got = V.scored(spark, sf_dir).agg(F.count("*").alias("n"), (F.avg(q) / 10000).alias("mean"), (F.stddev_pop(q) / 10000).alias("std"), (F.min(q) / 10000.0).alias("min"), p.alias("p"), (F.max(q) / 10000.0).alias("max"))
    names = ("p10", "p50", "p90", "p99")
    return quantized(got.select("*", *[(F.get("p", k) / 10000).alias(n) for k, n in enumerate(names)]).drop("p"), "mean", "std", *names)


@Q.query(with_views("SELECT CAST(q // 100 AS INTEGER) AS bin, count(*) AS n, CAST(sum(response) AS BIGINT) AS pos FROM scored GROUP BY 1", "scored"))
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_counts(V.scored(spark, sf_dir)).groupBy(F.floor(F.col("q") / 100).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


CUMULATIVE = with_views("SELECT q, n, CAST(pos AS BIGINT) AS pos, CAST(sum(pos) OVER (ORDER BY q DESC) AS BIGINT) AS cum_tp, CAST(sum(n - pos) OVER (ORDER BY q DESC) AS BIGINT) AS cum_fp FROM (SELECT q, count(*) AS n, sum(response) AS pos FROM scored GROUP BY q)", "scored")


@Q.query(CUMULATIVE)
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false positives at each score and above."""
    w = Window.orderBy(F.desc("q"))  # over distinct scores, of which the grid bounds the number
    c = E.score_counts(V.scored(spark, sf_dir))
    return c.select("q", "n", "pos", F.sum("pos").over(w).alias("cum_tp"), F.sum(F.col("n") - F.col("pos")).over(w).alias("cum_fp"))
