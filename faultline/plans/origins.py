"""Queries of rolling origins, of sinks that many write to, of manifests and of replays with late labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import evaluate as E
from faultline.operators import origins as O
from faultline.operators import reports as R
from faultline.operators.bootstrap import resampled
from faultline.operators.features import filled_start, time_blocks
from faultline.operators.folds import group_folds, leaks
from faultline.sources import ingest as I
from faultline.sources import views as V
from faultline.sources.scratch import materialize, shared_dir
from faultline.sources.views import q6, with_views
from faultline.streaming.replay import label_replay

from .book import Book
from .decisions import ORIGINS
from .features import BLOCK, quantized

Q = Book()

FILLED = "filled AS (SELECT * REPLACE (coalesce(start_time, min(start_time) OVER () - 1) AS start_time) FROM parts)"
BLOCKED = f"{FILLED}, blocked AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY start_time, id) - 1) * {ORIGINS + 1} / (SELECT count(*) FROM parts)) AS INTEGER) AS part FROM filled)"


def rates_sql(train: str, probe: str, fold: int, m: float) -> str:
    """Scores of the rows of `probe` by the path rates of `train`."""
    return f"""SELECT {fold} AS fold, id, response, CAST(floor(CASE WHEN r IS NULL THEN g ELSE (n * r + CAST({m} AS DOUBLE) * g) / (n + CAST({m} AS DOUBLE)) END * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS q
FROM (SELECT * FROM blocked WHERE {probe}) LEFT JOIN (SELECT path_signature, count(*) AS n, avg(response) AS r FROM blocked WHERE {train} GROUP BY 1) USING (path_signature), (SELECT avg(response) AS g FROM blocked WHERE {train})"""


def past_sql(m: float) -> str:
    return " UNION ALL ".join(rates_sql(f"part < {k}", f"part = {k}", k, m) for k in range(1, ORIGINS + 1))


def timed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(O.time_parts(filled_start(V.parts(spark, sf_dir)).select("id", "response", "start_time", "duration", "feature_mean", "path_signature"), ORIGINS + 1))


def origin_log(spark: SparkSession, sf_dir: str, m: float = 10.0) -> DataFrame:
    """The log of origins that are scored by past path rates."""
    return O.run_origins(timed_parts(spark, sf_dir), O.path_rates(m), shared_dir(spark))


@Q.query(with_views(past_sql(10.0), "parts", more=BLOCKED))
def rolling_origin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of five windows of time, each by all windows before it, read from the log of origins."""
    return origin_log(spark, sf_dir).select("fold", "id", "response", "q")


@Q.query(with_views(f"""SELECT {q6('avg(auc)')} AS mean, {q6('stddev_samp(auc)')} AS std, {q6('avg(auc) - 2.776 * stddev_samp(auc) / sqrt(CAST(5 AS DOUBLE))')} AS ci_lo, {q6('avg(auc) + 2.776 * stddev_samp(auc) / sqrt(CAST(5 AS DOUBLE))')} AS ci_hi, {q6('min(auc)')} AS min, {q6('max(auc)')} AS max, {q6('corr(k, auc)')} AS corr, {q6('arg_min(auc, k) - arg_max(auc, k)')} AS degradation
FROM (SELECT k, sum((n - pos) * (tp - pos / CAST(2 AS DOUBLE))) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(n) - sum(pos) AS DOUBLE), 0) AS auc FROM (SELECT k, q, n, pos, sum(pos) OVER (PARTITION BY k ORDER BY q DESC) AS tp FROM
  (SELECT fold AS k, q, count(*) AS n, sum(response) AS pos FROM past GROUP BY 1, 2)) GROUP BY k)""", "parts", more=f"{BLOCKED}, past AS ({past_sql(10.0)})"))
def rolling_origin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread, interval and trend of the AUC of rolling origins."""
    a, k = F.col("auc"), F.col("fold")
    half = F.lit(2.776) * F.stddev_samp(a) / F.sqrt(F.lit(5.0))
    got = E.roc_auc(origin_log(spark, sf_dir), "fold").agg(F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), (F.avg(a) - half).alias("ci_lo"), (F.avg(a) + half).alias("ci_hi"), F.min(a).alias("min"), F.max(a).alias("max"), F.corr(k, a).alias("corr"), (F.min_by(a, k) - F.max_by(a, k)).alias("degradation"))
    return quantized(got, *got.columns)


#: Arms of an experiment: how far path rates are shrunk.
ARMS = {"base": 10.0, "raw": 0.0, "strong": 100.0}
_FOLDS = {m: " UNION ALL ".join(rates_sql(f"id % 5 <> {k}", f"id % 5 = {k}", k, m) for k in range(5)) for m in ARMS.values()}
_BEST = """SELECT arm, split, max(CASE WHEN d <= 0 THEN CAST(0 AS DOUBLE) ELSE (CAST(tp AS DOUBLE) * CAST(tn AS DOUBLE) - CAST(fp AS DOUBLE) * CAST(fn AS DOUBLE)) / sqrt(d) END) AS mcc FROM (
  SELECT *, (CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE)) * (CAST(tp AS DOUBLE) + CAST(fn AS DOUBLE)) * (CAST(tn AS DOUBLE) + CAST(fp AS DOUBLE)) * (CAST(tn AS DOUBLE) + CAST(fn AS DOUBLE)) AS d FROM (
    SELECT arm, split, i, count(*) FILTER (WHERE q >= 100 * i AND response = 1) AS tp, count(*) FILTER (WHERE q >= 100 * i AND response = 0) AS fp, count(*) FILTER (WHERE q < 100 * i AND response = 1) AS fn, count(*) FILTER (WHERE q < 100 * i AND response = 0) AS tn FROM s, range(1, 100) g(i) GROUP BY arm, split, i)) GROUP BY arm, split"""


@Q.query(with_views(f"SELECT arm, {q6('oot / incv * 100')} AS retained_pct, {q6('incv - bi')} AS delta_incv, {q6('oot - bo')} AS delta_oot, CASE WHEN abs(incv - bi) > 1e-8 THEN {q6('(oot - bo) / (incv - bi) * 100')} END AS durability_pct FROM arms, (SELECT incv AS bi, oot AS bo FROM arms WHERE arm = 'base')", "parts",
    more=f"{BLOCKED}, s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, '{split}' AS split, q, response FROM ({sql})" for a, m in ARMS.items() for split, sql in (("incv", _FOLDS[m]), ("oot", past_sql(m)))) + f"), best AS ({_BEST}), arms AS (SELECT arm, max(mcc) FILTER (WHERE split = 'incv') AS incv, max(mcc) FILTER (WHERE split = 'oot') AS oot FROM best GROUP BY arm)"))
def durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three arms gain over the base in cross-validation, and what of it lasts on rolling origins: best MCC of path rates that are shrunk more or less."""
    rows, told = timed_parts(spark, sf_dir), []
    for arm, m in ARMS.items():
        oof = O.out_of_fold_path_rates(rows.withColumn("cv_fold", F.col("id") % 5), "cv_fold", m).withColumn("q", F.floor(F.col("pred") * E.SCALE + 0.5).cast("int"))
        past = O.run_origins(rows, O.path_rates(m), shared_dir(spark))
        told.append((arm, *[E.best_threshold(x).first().mcc for x in (oof, past)]))  # one number for each arm and split
    got = R.durability(spark.createDataFrame(told, "arm string, incv double, oot double"), "base").drop("incv", "oot")
    return quantized(got, "retained_pct", "delta_incv", "delta_oot", "durability_pct")


@Q.query()
def ci_regime_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime of the last origins against the first ones, by bootstrap intervals of AUC and lift from the log."""
    return O.regime(resampled(origin_log(spark, sf_dir), "fold", replicates=100), (1, 2), (4, 5))


@Q.query()
def prevalence_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all metrics of each origin once its positives are thinned to the share of the origin that has the fewest; origins that can't be are rows that say why."""
    log = materialize(origin_log(spark, sf_dir))
    least = log.groupBy("fold").agg(F.avg("response").alias("r")).agg(F.min("r")).first()[0] or 0.0
    return resampled(log, "fold", replicates=100, prevalence=least)


@Q.query(with_views(f"SELECT 'by_block' AS dealing, count(DISTINCT time_block) AS groups, CAST(0 AS BIGINT) AS leaking FROM timed UNION ALL SELECT 'by_part', count(*), count(*) FILTER (WHERE f > 1) FROM (SELECT time_block, count(DISTINCT id % 5) AS f FROM timed GROUP BY 1)", "parts", more=f"{FILLED}, timed AS (SELECT id, (row_number() OVER (ORDER BY start_time, id) - 1) // {BLOCK} AS time_block FROM filled)"))
def fold_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of time that more than one fold has: none where whole blocks are dealt, all that are large where parts are."""
    rows = materialize(time_blocks(filled_start(V.parts(spark, sf_dir)).select("id", "response", "start_time"), BLOCK))
    out = None
    for name, dealt in (("by_block", group_folds(rows, "time_block", "response", 5)), ("by_part", rows.withColumn("cv_fold", F.col("id") % 5))):
        got = leaks(dealt, "time_block", "cv_fold").agg(F.lit(name).alias("dealing"), F.count("*").alias("groups"), F.count_if("leaks").alias("leaking"))
        out = got if out is None else out.unionByName(got)
    return out


#: Manifests over the tables: (manifest, table, action, whether a sample was asked for, how far the rows on record are from the table's, if any are).
MANIFESTS = (("full", "nation", "generated", False, None), ("full", "orders", "generated", False, None), ("mixed", "nation", "generated", False, None), ("mixed", "orders", "generated", True, None), ("doubt", "part", "skipped", False, 1), ("doubt", "nation", "generated", False, None), ("sample", "supplier", "skipped", False, 0), ("sample", "customer", "generated", True, None))


@Q.query("SELECT manifest, CASE WHEN bool_or(s = 'generated_full') AND bool_or(s IN ('generated_sample', 'sampled')) THEN 'mixed' WHEN bool_or(s = 'unverified') THEN 'unknown' WHEN bool_or(s = 'generated_full') THEN 'full_data' WHEN bool_or(s IN ('generated_sample', 'sampled')) THEN 'sample' ELSE 'unknown' END AS overall, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT manifest, rows, CASE WHEN action = 'generated' THEN CASE WHEN sample THEN 'generated_sample' ELSE 'generated_full' END WHEN known = rows THEN 'sampled' ELSE 'unverified' END AS s FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS manifest, '{t}' AS file, '{a}' AS action, {str(s).lower()} AS sample, (SELECT count(*) FROM {t}) AS rows, {'NULL' if off is None else f'(SELECT count(*) + {off} FROM {t})'} AS known" for m, t, a, s, off in MANIFESTS) + ")) GROUP BY manifest")
def provenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far manifests over the tables can be trusted, by the rows that the tables have."""
    out = None
    for m, t, a, s, off in MANIFESTS:
        got = V.table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(m).alias("manifest"), F.lit(t).alias("file"), F.lit(a).alias("action"), F.lit(s).alias("sample"), "rows", (F.lit(None).cast("long") if off is None else F.col("rows") + off).alias("known"))
        out = got if out is None else out.unionByName(got)
    files = out.withColumn("status", I.file_status(F.col("action"), F.col("sample"), F.col("rows"), F.col("known")))
    return I.overall_status(files, "status", "manifest").join(files.groupBy("manifest").agg(F.sum("rows").alias("rows")), "manifest")


@Q.query(with_views("SELECT id % 4 AS batch, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, CAST(1 AS BIGINT) AS writers FROM scored GROUP BY 1", "scored"))
def racing_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers race for each of four batches; every batch is there once, from one of them."""
    base, s = shared_dir(spark), V.scored(spark, sf_dir).drop(V.LABEL)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: I.write_partition(s.where(F.col("id") % 4 == x[0]).withColumn("writer", F.lit(x[1])), base, {"batch": x[0]}), [(b, w) for b in range(4) for w in range(2)]))
    got = I.read_partitions(spark, base)
    return got.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.countDistinct("writer").alias("writers"))


WIDTH, CYCLE, SLICES = 500, 2200, 4
#: Scores of a slice: more of them make more slices, so that a micro-batch doesn't grow with the table.
SLICE_ROWS = 450_000


@Q.query(with_views(f"""SELECT line, cycle_id * {-(-CYCLE // WIDTH)} + w AS run_seq, cycle_id, w AS "window", count(*) AS rows, count(*) FILTER (WHERE known) AS labelled, count(*) FILTER (WHERE known AND d AND y) AS tp, count(*) FILTER (WHERE known AND d AND NOT y) AS fp, count(*) FILTER (WHERE known AND NOT d AND y) AS fn, count(*) FILTER (WHERE known AND NOT d AND NOT y) AS tn
FROM (SELECT line, place // {CYCLE} AS cycle_id, place % {CYCLE} // {WIDTH} AS w, id % 10 <> 0 AS known, q >= 6000 AS d, response = 1 AS y FROM (SELECT *, 'L' || CAST(id % 3 AS VARCHAR) AS line, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS place FROM scored))
GROUP BY line, cycle_id, w HAVING count(*) = least({WIDTH}, {CYCLE} - w * {WIDTH})""", "scored"))
def label_replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of scores and of labels that come later, some of them too late: metrics of each window of three lines, held in the state store."""
    base, s = shared_dir(spark), V.scored(spark, sf_dir)
    last, n = s.agg(F.max("id"), F.count("*")).first()
    slices, last = max(SLICES, -(-n // SLICE_ROWS)), last or 0
    s = s.withColumns({"line": F.concat(F.lit("L"), (F.col("id") % 3).cast("string")), "slice": F.floor(F.col("id") * slices / F.lit(last + 1)).cast("int")})
    hour = lambda c: F.timestamp_seconds((c + 24) * 3600)  # noqa: E731  the watermark begins at 0, and what isn't after it is late
    scores = s.select("line", F.col("id").alias("seq"), F.lit("score").alias("kind"), "id", "q", F.lit(None).cast("int").alias("response"), hour(F.col("slice")).alias("ts"), F.col("slice").alias("file"))
    late, turn = F.col("id") % 10 == 0, F.floor(F.col("slice") / 10).cast("int")  # late ones come when all scores are given up, those of ten slices together
    at = F.when(late, turn + slices + 3).otherwise(F.col("slice") + 1)
    labels = s.select("line", F.col("id").alias("seq"), F.lit("label").alias("kind"), "id", F.lit(None).cast("int").alias("q"), "response", hour(F.when(late, turn + slices + 26).otherwise(at)).alias("ts"), at.alias("file"))
    ticks = spark.range(2).select(F.lit("L0").alias("line"), F.col("id").alias("seq"), F.lit("tick").alias("kind"), "id", F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("response"), hour(F.col("id") + slices + 16).alias("ts"), (F.col("id") + slices + 1).cast("int").alias("file"))
    events = scores.unionByName(labels).unionByName(ticks)
    events.write.partitionBy("file").parquet(f"{base}/staged")
    schema, staged = events.drop("file").schema, spark.read.schema(events.schema).parquet(f"{base}/staged")
    for k in range(slices + 4 + (slices - 1) // 10):  # files come one after the other
        staged.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = label_replay(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), width=WIDTH, cycle_rows=CYCLE)
    got.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@Q.query("""WITH e AS (SELECT event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY 1)
SELECT event_type, path, name, value, threshold, value > threshold AS exceeded FROM (
  SELECT event_type, '$' AS path, 'rows' AS name, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold FROM e
  UNION ALL SELECT event_type, '$.parts[0]', 'total', """ + q6("total") + """, CAST(1000 AS DOUBLE) FROM e
  UNION ALL SELECT event_type, '$.parts[1].inner.deep[0]', 'value', """ + q6("most") + """, CAST(0.5 AS DOUBLE) FROM e)""")
def report_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and thresholds of nested reports on the events, at whatever depth they are."""
    e = quantized(V.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")), "total", "most")
    deep = F.struct(F.struct(F.array(F.struct(F.lit("value").alias("column"), F.col("most").alias("value"), F.lit(0.5).alias("threshold"))).alias("deep")).alias("inner"), F.lit("no number").alias("value"))
    flat = F.struct(F.lit("total").alias("metric_name"), F.col("total").alias("value"), F.lit(1000).alias("threshold"))
    texts = e.select("event_type", F.concat(F.lit('{"name": "rows", "empty": {}, "value": '), F.col("n").cast("string"), F.lit(', "parts": ['), F.to_json(flat), F.lit(", "), F.to_json(deep), F.lit("]}")).alias("report"))
    return R.measures(R.walk(texts, "report", "event_type"), "event_type")
