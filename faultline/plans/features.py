"""Feature queries: times, stations, paths, history, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import exprs as X
from faultline.operators import features as ops
from faultline.operators.ordered import centered_counts, joined, quantiles, running
from faultline.sources import views as V
from faultline.sources.scratch import materialize
from faultline.sources.views import q6, with_views

from .book import Book

Q = Book()
STATIONS = [f"L{x}_S{s}" for x in range(4) for s in (0, 5, 10)]
LINES = [f"L{x}" for x in range(4)]
FILLED = "filled AS (SELECT * REPLACE (coalesce(start_time, min(start_time) OVER () - 1) AS start_time) FROM parts)"
BLOCK = 1000
#: Rows that a rolling rate looks back.
WINDOW = 10_000


def quantized(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.quantized(F.col(c)) for c in columns})


@Q.query(with_views(f"""
SELECT id, response, start_time, duration, {q6('feature_mean')} AS feature_mean, records_last_1hr, records_last_24hr,
  CAST(records_last_1hr AS DOUBLE) / CAST(greatest(records_last_24hr, 1) AS DOUBLE) AS density_ratio, CAST(floor(pos / {BLOCK}) AS INTEGER) AS time_block, count(*) OVER (PARTITION BY CAST(floor(pos / {BLOCK}) AS INTEGER)) AS block_size
FROM (SELECT *, count(*) OVER (ORDER BY start_time RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) - later AS records_last_1hr,
    count(*) OVER (ORDER BY start_time RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) - later AS records_last_24hr
  FROM (SELECT *, count(*) OVER (PARTITION BY start_time) - row_number() OVER (PARTITION BY start_time ORDER BY id) AS later, row_number() OVER (ORDER BY start_time, id) - 1 AS pos FROM filled))
""", "parts", more=FILLED))  # fmt: skip
def core_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.core_features(V.parts(spark, sf_dir), block=BLOCK)
    return quantized(got, "feature_mean").select("id", "response", "start_time", "duration", "feature_mean", "records_last_1hr", "records_last_24hr", "density_ratio", "time_block", "block_size")


@Q.query(with_views("SELECT id, " + ", ".join(f"{q6(f'avg(value) FILTER (WHERE station = $${s}$$)')} AS {s}" for s in STATIONS).replace("$$", "'") + " FROM readings GROUP BY id", "readings"))
def station_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(ops.station_means(V.readings(spark, sf_dir), STATIONS), *STATIONS)


@Q.query(with_views("SELECT id, " + ", ".join(f"CAST(count(value) FILTER (WHERE station = '{s}') > 0 AS INTEGER) AS {s}" for s in STATIONS) + " FROM readings GROUP BY id", "readings"))
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.station_means(V.readings(spark, sf_dir), STATIONS)
    return got.select("id", *[F.col(s).isNotNull().cast("int").alias(s) for s in STATIONS])


@Q.query(with_views("SELECT id, " + ", ".join(f"min(t) FILTER (WHERE line = '{x}') AS start_{x}, max(t) FILTER (WHERE line = '{x}') AS end_{x}, coalesce(max(t) FILTER (WHERE line = '{x}') - min(t) FILTER (WHERE line = '{x}'), 0) AS duration_{x}, count(DISTINCT station) FILTER (WHERE line = '{x}') AS stations_{x}" for x in LINES) + ", count(DISTINCT station) AS stations FROM readings GROUP BY id", "readings"))
def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stations first: the counts of distinct stations are then plain counts.
    by = V.readings(spark, sf_dir).groupBy("id", "line", "station").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    out = []
    for x in LINES:
        on = F.col("line") == x
        a, b = F.min(F.when(on, F.col("a"))), F.max(F.when(on, F.col("b")))
        out += [a.alias(f"start_{x}"), b.alias(f"end_{x}"), F.coalesce(b - a, F.lit(0.0)).alias(f"duration_{x}"), F.count_if(on).alias(f"stations_{x}")]
    return by.groupBy("id").agg(*out, F.count("*").alias("stations"))


@Q.query(with_views(f"""
SELECT id, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, count(value) AS nonnull,
  {q6("stddev_samp(value) FILTER (WHERE station LIKE '%_S5')")} AS std_s5, min(value) FILTER (WHERE station LIKE '%_S10') AS min_s10,
  {q6('(12 - count(DISTINCT station)) / CAST(12 AS DOUBLE) * stddev_samp(value)')} AS sparsity_std
FROM readings GROUP BY id""", "readings"))
def row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = F.col("value"), F.col("station")
    got = V.readings(spark, sf_dir).groupBy("id").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.count(v).alias("nonnull"),
        F.stddev_samp(F.when(s.endswith("_S5"), v)).alias("std_s5"), F.min(F.when(s.endswith("_S10"), v)).alias("min_s10"), F.size(F.collect_set(s)).alias("k"),
    )
    return quantized(got.withColumn("sparsity_std", (12 - F.col("k")) / F.lit(12.0) * F.col("std")).drop("k"), "mean", "std", "std_s5", "sparsity_std")


@Q.query(with_views("SELECT id, path_signature, CASE WHEN path_signature = '__none__' THEN 0 ELSE len(string_split(path_signature, '|')) END AS stations FROM parts", "parts"))
def path_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.parts(spark, sf_dir).select("id", "path_signature", F.size(X.tokens(F.col("path_signature"))).cast("long").alias("stations"))


@Q.query(with_views("""SELECT o_orderkey AS id, coalesce(p, 'no_stations') AS path FROM orders LEFT JOIN (SELECT id, string_agg(station, '|' ORDER BY l, s) AS p FROM
  (SELECT DISTINCT id, station, CAST(substr(line, 2) AS INTEGER) AS l, CAST(split_part(station, '_S', 2) AS INTEGER) AS s FROM readings) GROUP BY id) ON id = o_orderkey""", "readings"))
def path_signature_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations in the order of their line and station numbers."""
    one = F.struct(F.substring("line", 2, 9).cast("int").alias("l"), F.substring_index("station", "_S", -1).cast("int").alias("s"), "station")
    got = V.readings(spark, sf_dir).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda x: x["station"]), "|").alias("path"))
    ids = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return ids.join(got, "id", "left").select("id", F.coalesce("path", F.lit(X.NO_STATIONS)).alias("path"))


@Q.query(with_views("SELECT id, path_signature, count(*) OVER (PARTITION BY path_signature) AS path_count FROM parts", "parts"))
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.parts(spark, sf_dir).select("id", "path_signature")
    counts = materialize(p.groupBy("path_signature").agg(F.count("*").alias("path_count")))  # written: a join of two plain shuffles can be split at a hot path
    return p.join(counts, "path_signature")


@Q.query(with_views(f"SELECT path_signature, count(*) AS n, {q6('(count(*) * avg(response) + 10 * (SELECT avg(response) FROM parts)) / (count(*) + 10)')} AS rate FROM parts GROUP BY path_signature", "parts"))
def path_smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(ops.smoothed_rates(V.parts(spark, sf_dir), "path_signature"), "rate").drop("r")


@Q.query(with_views("SELECT id, c AS path_count, CASE WHEN c <= 10 THEN 0 WHEN c <= 100 THEN 1 ELSE 2 END AS tier FROM (SELECT id, count(*) OVER (PARTITION BY path_signature) AS c FROM parts)", "parts"))
def path_risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_counts(spark, sf_dir).select("id", "path_count", X.risk_tier(F.col("path_count")).alias("tier"))


TOKENS = """sig AS (SELECT path_signature, sum(response) AS pos, count(*) AS n, CASE WHEN path_signature = '__none__' THEN [] ELSE string_split(path_signature, '|') END AS path FROM parts GROUP BY path_signature)"""
TRANSITIONS = "list_transform(range(1, len(path)), lambda i: path[i] || '>' || path[i + 1])"
PAIRS = "flatten(list_transform(range(1, len(path) + 1), lambda i: list_transform(range(i + 1, len(path) + 1), lambda j: path[i] || '&' || path[j])))"


@Q.query(with_views("SELECT token, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate FROM (SELECT unnest(path) AS token, pos, n FROM sig) GROUP BY token", "parts", more=TOKENS))
def station_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.path_lookup(V.parts(spark, sf_dir))["station"]


@Q.query(with_views(f"SELECT token, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate FROM (SELECT unnest({TRANSITIONS}) AS token, pos, n FROM sig) GROUP BY token", "parts", more=TOKENS))
def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.path_lookup(V.parts(spark, sf_dir))["transition"]


@Q.query(with_views(f"SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest({PAIRS}) AS token, n FROM sig) GROUP BY token", "parts", more=TOKENS))
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.path_lookup(V.parts(spark, sf_dir))["pair"]


PATH_COLUMNS = ["transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std", "station_risk_mean", "pair_cooccur_mean", "pair_cooccur_max", "pair_cooccur_std"]


def path_sql(train: str, probe: str, overall: str, tag: str) -> str:
    """CTEs f{tag}: path features of the signatures of `probe` by what `train` says."""
    return f"""
s{tag} AS (SELECT path_signature, sum(response) AS pos, count(*) AS n, CASE WHEN path_signature = '__none__' THEN [] ELSE string_split(path_signature, '|') END AS path FROM {train} GROUP BY 1),
st{tag} AS (SELECT token, CAST(sum(pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate FROM (SELECT unnest(path) AS token, pos, n FROM s{tag}) GROUP BY token),
tr{tag} AS (SELECT token, CAST(sum(pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate FROM (SELECT unnest({TRANSITIONS}) AS token, pos, n FROM s{tag}) GROUP BY token),
pr{tag} AS (SELECT token, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT unnest({PAIRS}) AS token, n FROM s{tag}) GROUP BY token),
p{tag} AS (SELECT DISTINCT path_signature, CASE WHEN path_signature = '__none__' THEN [] ELSE string_split(path_signature, '|') END AS path FROM {probe}),
ft{tag} AS (SELECT path_signature, avg(coalesce(rate, {overall})) AS a, max(coalesce(rate, {overall})) AS b, stddev_pop(coalesce(rate, {overall})) AS c FROM (SELECT path_signature, unnest({TRANSITIONS}) AS token FROM p{tag}) LEFT JOIN tr{tag} USING (token) GROUP BY 1),
fs{tag} AS (SELECT path_signature, avg(coalesce(rate, {overall})) AS a FROM (SELECT path_signature, unnest(path) AS token FROM p{tag}) LEFT JOIN st{tag} USING (token) GROUP BY 1),
fp{tag} AS (SELECT path_signature, avg(n) AS a, max(n) AS b, stddev_pop(n) AS c FROM (SELECT path_signature, unnest({PAIRS}) AS token FROM p{tag}) LEFT JOIN pr{tag} USING (token) GROUP BY 1),
f{tag} AS (SELECT p.path_signature, {q6(f'coalesce(ft.a, {overall})')} AS transition_fail_rate_mean, {q6(f'coalesce(ft.b, {overall})')} AS transition_fail_rate_max, {q6('coalesce(ft.c, 0)')} AS transition_fail_rate_std, {q6(f'coalesce(fs.a, {overall})')} AS station_risk_mean,
  CAST(coalesce(s.n, 1) AS BIGINT) AS path_count, {q6('coalesce(fp.a, 0)')} AS pair_cooccur_mean, {q6('coalesce(fp.b, 0)')} AS pair_cooccur_max, {q6('coalesce(fp.c, 0)')} AS pair_cooccur_std
  FROM p{tag} p LEFT JOIN ft{tag} ft USING (path_signature) LEFT JOIN fs{tag} fs USING (path_signature) LEFT JOIN fp{tag} fp USING (path_signature) LEFT JOIN s{tag} s USING (path_signature))"""


@Q.query(with_views("SELECT id, f0.* FROM even JOIN f0 USING (path_signature) UNION ALL SELECT id, f1.* FROM odd JOIN f1 USING (path_signature)", "parts", more="even AS (SELECT * FROM parts WHERE id % 2 = 0), odd AS (SELECT * FROM parts WHERE id % 2 = 1)," + path_sql("odd", "even", "(SELECT avg(response) FROM odd)", "0") + "," + path_sql("even", "odd", "(SELECT avg(response) FROM even)", "1")))
def dataset_h_lookup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fitted lookup says of parts that it hasn't seen: each half of the parts by the other half."""
    parts, out = materialize(V.parts(spark, sf_dir).select("id", "path_signature", "response")), None
    for k in range(2):
        train = parts.where(F.col("id") % 2 != k)
        got = ops.path_features(parts.where(F.col("id") % 2 == k).select("id", "path_signature"), ops.path_lookup(train), train.agg(F.avg("response")).first()[0])
        out = got if out is None else out.unionByName(got)
    return quantized(out, *PATH_COLUMNS)


FOLDED = f"folded AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY start_time, id) - 1) / {BLOCK}) AS INTEGER) AS time_block, CAST(CAST(floor((row_number() OVER (ORDER BY start_time, id) - 1) / {BLOCK}) AS INTEGER) % 5 AS INTEGER) AS cv_fold FROM filled), g AS (SELECT avg(response) AS g FROM parts)"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts in blocks by time, and folds of blocks by a formula."""
    return ops.time_blocks(ops.filled_start(V.parts(spark, sf_dir)), BLOCK).withColumn("cv_fold", F.col("time_block") % 5)


@Q.query(with_views(" UNION ALL ".join(f"SELECT id, cv_fold, f{k}.* FROM (SELECT id, cv_fold, path_signature FROM folded WHERE cv_fold = {k}) JOIN f{k} USING (path_signature)" for k in range(5)), "parts",
    more=FILLED + ", " + FOLDED + "".join("," + path_sql(f"(SELECT * FROM folded WHERE cv_fold <> {k})", f"(SELECT * FROM folded WHERE cv_fold = {k})", "(SELECT g FROM g)", str(k)) for k in range(5))))
def dataset_h_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path features of every part, from the parts of the other folds."""
    rows = folded(spark, sf_dir).select("id", "cv_fold", "path_signature", "response")
    overall = rows.agg(F.avg("response")).first()[0]
    got = ops.path_features(rows.drop("response"), ops.path_lookup(rows, fold="cv_fold", folds=5), overall, fold="cv_fold")
    return quantized(got, *PATH_COLUMNS)


ROLL = """past{k} AS (SELECT start_time, arg_max(r, id) AS r FROM (SELECT start_time, id, coalesce(avg(response) OVER (ORDER BY start_time, id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), (SELECT g FROM g)) AS r FROM {train}) GROUP BY start_time)"""


@Q.query(with_views(" UNION ALL ".join(f"""SELECT id, cv_fold, {q6('coalesce(r, (SELECT g FROM g))')} AS rolling_fail_rate, {q6('coalesce(s, (SELECT g FROM g))')} AS signature_failure_rate, {q6('duration * coalesce(s, (SELECT g FROM g))')} AS duration_x_path_failure_rate, {q6('feature_mean * duration')} AS feature_mean_x_duration
  FROM (SELECT * FROM folded WHERE cv_fold = {k}) v ASOF LEFT JOIN past{k} p ON v.start_time >= p.start_time LEFT JOIN (SELECT path_signature, avg(response) AS s FROM folded WHERE cv_fold <> {k} GROUP BY 1) USING (path_signature)""" for k in range(5)), "parts",
    more=FILLED + ", " + FOLDED + "".join(", " + ROLL.format(k=k, w=WINDOW, train=f"(SELECT * FROM folded WHERE cv_fold <> {k})") for k in range(5))))
def dataset_g_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the last 10,000 parts and of the path, from the parts of the other folds, and products."""
    rows = folded(spark, sf_dir).select("id", "cv_fold", "path_signature", "response", "start_time", "duration", "feature_mean")
    overall = rows.agg(F.avg("response")).first()[0]

    train = ops.other_folds(rows.select("id", "cv_fold", "response", "start_time"), "cv_fold", 5)
    got = ops.rolling_rate(train, rows.drop("response"), overall, rows=WINDOW, by=["cv_fold"])
    rate = ops.path_lookup(rows, fold="cv_fold", folds=5)["path"].select("cv_fold", "path_signature", (F.col("pos") / F.col("n")).alias("signature_failure_rate"))
    got = got.join(rate, ["cv_fold", "path_signature"], "left").withColumn("signature_failure_rate", F.coalesce("signature_failure_rate", F.lit(overall)))
    got = got.withColumns({"duration_x_path_failure_rate": F.col("duration") * F.col("signature_failure_rate"), "feature_mean_x_duration": F.col("feature_mean") * F.col("duration")})
    names = ["rolling_fail_rate", "signature_failure_rate", "duration_x_path_failure_rate", "feature_mean_x_duration"]
    return quantized(got, *names).select("id", "cv_fold", *names)


@Q.query(with_views(" UNION ALL ".join(f"SELECT id, {q6('coalesce(r, (SELECT g FROM g))')} AS rolling_fail_rate FROM (SELECT * FROM parts WHERE id % 3 = {k}) v ASOF LEFT JOIN past{k} p ON v.start_time >= p.start_time" for k in range(3)), "parts",
    more="g AS (SELECT avg(response) AS g FROM parts)" + "".join(", " + ROLL.format(k=k, w=WINDOW, train=f"(SELECT * FROM parts WHERE id % 3 <> {k} AND start_time IS NOT NULL)") for k in range(3))))
def rolling_fail_rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third of the parts by the other two."""
    parts = materialize(V.parts(spark, sf_dir).select("id", "response", "start_time", (F.col("id") % 3).cast("int").alias("third")))
    overall = parts.agg(F.avg("response")).first()[0]
    got = ops.rolling_rate(ops.other_folds(parts, "third", 3), parts.drop("response"), overall, rows=WINDOW, by=["third"])
    return quantized(got.select("id", "rolling_fail_rate"), "rolling_fail_rate")


@Q.query(with_views("SELECT p.id, " + ", ".join(f"{q6(f'CASE WHEN coalesce(n, 0) >= {k} THEN p.end_time - (hi.s - coalesce(lo{k}.s, 0)) / {k} END')} AS since_{k}" for k in (1, 5, 10)) +
    " FROM parts p LEFT JOIN before USING (id) LEFT JOIN summed hi ON hi.i = n " + " ".join(f"LEFT JOIN summed lo{k} ON lo{k}.i = n - {k}" for k in (1, 5, 10)), "parts",
    more="""failed AS (SELECT end_time AS t, id FROM parts WHERE response = 1 AND end_time IS NOT NULL), summed AS (SELECT row_number() OVER (ORDER BY t, id) AS i, sum(t) OVER (ORDER BY t, id) AS s FROM failed),
before AS (SELECT p.id, count(f.t) AS n FROM parts p LEFT JOIN failed f ON f.t < p.end_time GROUP BY p.id)"""))
def since_last_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.since_failures(V.parts(spark, sf_dir).select("id", "response", "end_time"))
    return quantized(got.select("id", "since_1", "since_5", "since_10"), "since_1", "since_5", "since_10")


@Q.query("SELECT event_id, count(*) OVER (ORDER BY s RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) - 1 AS same_window FROM (SELECT event_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS s FROM events)")
def same_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return centered_counts(V.table(spark, sf_dir, "events").select("event_id", s.alias("s")), "s", "same_window", 60.0).select("event_id", "same_window")


@Q.query(with_views("""SELECT id, """ + ", ".join(f"least(row_number() OVER (ORDER BY id), {w}) AS last_{w}, least(count(*) OVER () - row_number() OVER (ORDER BY id) + 1, {w}) AS next_{w}" for w in (25, 240, 1680)) +
    """, CAST(id % 1680 AS INTEGER) AS week_part, CASE WHEN (id // 10) % 24 = 0 THEN NULL WHEN (id // 10) % 24 <= 8 THEN 1 WHEN (id // 10) % 24 <= 16 THEN 2 ELSE 3 END AS shift FROM parts""", "parts"))
def legacy_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.legacy_features(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@Q.query(with_views(f"""SELECT id, start_time - 1680 * floor(start_time / 1680) AS in_week, CAST(floor(start_time / 240) - 7 * floor(floor(start_time / 240) / 7) AS INTEGER) AS day, CAST(floor(start_time / 10) - 24 * floor(floor(start_time / 10) / 24) AS INTEGER) AS hour,
  {q6('ln(1 + duration)')} AS log_duration, {q6('(duration - (SELECT avg(duration) FROM parts)) / (SELECT CASE WHEN coalesce(stddev_samp(duration), 0) <= 0 THEN 1 ELSE stddev_samp(duration) END FROM parts)')} AS z_duration,
  CAST(duration > (SELECT quantile_cont(duration, 0.9) FROM parts) AS INTEGER) AS is_long, CAST(duration < (SELECT quantile_cont(duration, 0.1) FROM parts) AS INTEGER) AS is_short FROM parts""", "parts"))
def cyclic_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.parts(spark, sf_dir)
    got = ops.date_features(p.select("id", "start_time", "duration"), ops.duration_stats(p))
    return quantized(got.drop("start_time", "duration"), "log_duration", "z_duration")


@Q.query(with_views("""SELECT id, dup_run, count(*) OVER (PARTITION BY dup_run) AS run_size, row_number() OVER (PARTITION BY dup_run ORDER BY start_time NULLS LAST, id) AS run_rank, row_number() OVER (PARTITION BY dup_run ORDER BY start_time DESC NULLS FIRST, id DESC) AS run_rank_desc
FROM (SELECT *, CAST(sum(new) OVER (ORDER BY start_time NULLS LAST, id) AS BIGINT) AS dup_run FROM (SELECT *, CASE WHEN path_signature = lag(path_signature) OVER (ORDER BY start_time NULLS LAST, id) THEN 0 ELSE 1 END AS new FROM parts))""", "parts"))
def duplicate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.duplicate_runs(V.parts(spark, sf_dir).select("id", "start_time", "path_signature"), ["path_signature"], "start_time", "id")
    return got.select("id", "dup_run", "run_size", *[F.col(c).cast("long").alias(c) for c in ("run_rank", "run_rank_desc")])


VALUES = "sv AS (SELECT id, station, avg(value) AS v FROM readings GROUP BY id, station)"


@Q.query(with_views("SELECT id, station, count(*) OVER (PARTITION BY station, v) AS same, row_number() OVER (PARTITION BY station, v ORDER BY id) AS occurrence FROM sv", "readings", more=VALUES))
def station_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sv = V.readings(spark, sf_dir).groupBy("id", "station").agg(F.avg("value").alias("v"))
    placed = running(sv, [F.col("id")], by=["station", "v"])
    return joined(placed, materialize(sv.groupBy("station", "v").agg(F.count("*").alias("same"))), ["station", "v"]).select("id", "station", "same", (F.col("pos") + 1).alias("occurrence"))


@Q.query(with_views(f"""SELECT id, n AS concat_count, gated, {q6('ln(1 + n) + ln(1 + gated)')} AS log_counts FROM (SELECT id, count(*) OVER (PARTITION BY c) AS n,
  CASE WHEN (SELECT count(DISTINCT c) FROM cc) / CAST((SELECT count(*) FROM cc) AS DOUBLE) >= CAST(0.01 AS DOUBLE) THEN count(*) OVER (PARTITION BY c) ELSE 0 END AS gated FROM cc)""", "readings", more=VALUES + """, cc AS (SELECT id, string_agg(station || ':' || CAST(CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY station) AS c FROM sv GROUP BY id)"""))
def concat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have the same rounded values at all stations, gated by how distinct they are."""
    sv = V.readings(spark, sf_dir).groupBy("id", "station").agg(F.avg("value").alias("v"))
    cc = sv.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("station", F.lit(":"), F.floor(F.col("v") * 1000000 + 0.5).cast("string")))), ",").alias("c"))
    counts = materialize(cc.groupBy("c").agg(F.count("*").alias("n")))
    share = counts.agg(F.count("*") / F.sum("n").cast("double")).first()[0]
    got = cc.join(counts, "c").withColumn("gated", F.col("n") if share is not None and share >= 0.01 else F.lit(0).cast("long"))
    return got.select("id", F.col("n").alias("concat_count"), "gated", X.quantized(F.log1p("n") + F.log1p("gated")).alias("log_counts"))


@Q.query(with_views(f"""SELECT id, coalesce(lag(feature_mean) OVER w, -1) AS prev_value, coalesce(lead(feature_mean) OVER w, -1) AS next_value, CAST(lag(feature_mean) OVER w IS NULL AS INTEGER) AS no_prev,
  {q6('coalesce(avg(n_values) OVER (PARTITION BY path_signature ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS past_mean, row_number() OVER (PARTITION BY path_signature ORDER BY n_values DESC, id) AS value_rank,
  {q6('(row_number() OVER w - 1) / CAST(greatest(count(*) OVER (PARTITION BY path_signature) - 1, 1) AS DOUBLE)')} AS position_ratio, CAST(row_number() OVER w = 1 AS INTEGER) AS is_start, CAST(row_number() OVER w = count(*) OVER (PARTITION BY path_signature) AS INTEGER) AS is_end
FROM (SELECT id, path_signature, {q6('feature_mean')} AS feature_mean, n_values FROM parts) WINDOW w AS (PARTITION BY path_signature ORDER BY id)""", "parts"))
def run_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quantized(V.parts(spark, sf_dir).select("id", "path_signature", "feature_mean", "n_values"), "feature_mean")
    return ops.run_neighbours(p, "path_signature", "id", "feature_mean", "n_values").select(
        "id", F.coalesce("prev", F.lit(-1.0)).alias("prev_value"), F.coalesce("next", F.lit(-1.0)).alias("next_value"), F.col("prev").isNull().cast("int").alias("no_prev"), X.quantized(F.coalesce("past_mean", F.lit(0.0))).alias("past_mean"),
        "value_rank", X.quantized(F.col("position_ratio")).alias("position_ratio"), (F.col("pos") == 0).cast("int").alias("is_start"), (F.col("pos") == F.col("n") - 1).cast("int").alias("is_end"),
    )


@Q.query(with_views(f"SELECT path_signature, {q6('avg(n_values)')} AS mean, max(n_values) AS max, {q6('coalesce(stddev_samp(n_values), 0)')} AS std, max(n_values) - min(n_values) AS range FROM parts GROUP BY path_signature", "parts"))
def run_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("n_values")
    got = V.parts(spark, sf_dir).groupBy("path_signature").agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), (F.max(v) - F.min(v)).alias("range"))
    return quantized(got, "mean", "std")


@Q.query(with_views(" UNION ALL ".join(f"SELECT id, {q6(f'coalesce(r, (SELECT avg(response) FROM parts WHERE id % 2 <> {k}))')} AS path_target_enc FROM (SELECT * FROM parts WHERE id % 2 = {k}) LEFT JOIN (SELECT path_signature, avg(response) AS r FROM parts WHERE id % 2 <> {k} GROUP BY 1) USING (path_signature)" for k in range(2)), "parts"))
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half of the parts by the labels of the other half."""
    parts = materialize(V.parts(spark, sf_dir).select("id", "path_signature", "response"))
    a, b = (ops.target_encoded(parts.where(F.col("id") % 2 == k), parts.where(F.col("id") % 2 != k), "path_signature", "path_target_enc") for k in range(2))
    return quantized(a.unionByName(b).select("id", "path_target_enc"), "path_target_enc")


@Q.query(with_views(f"SELECT id, mean, max, std, range, CAST(rank() OVER (PARTITION BY path_signature ORDER BY n_values DESC) AS BIGINT) AS value_rank FROM parts JOIN (SELECT path_signature, {q6('avg(n_values)')} AS mean, max(n_values) AS max, {q6('coalesce(stddev_samp(n_values), 0)')} AS std, max(n_values) - min(n_values) AS range FROM parts GROUP BY path_signature) USING (path_signature)", "parts"))
def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the group of a part's path says, for each part, and the rank of its own value in it."""
    p = materialize(V.parts(spark, sf_dir).select("id", "path_signature", "n_values"))
    # Ranks from counts at each value: few, whatever the number of parts.
    at = running(p.groupBy("path_signature", "n_values").agg(F.count("*").alias("n")), [F.desc("n_values")], {"upto": F.col("n")}, None, ["path_signature"])
    got = p.join(materialize(at.select("path_signature", "n_values", (F.col("upto") - F.col("n") + 1).alias("value_rank"))), ["path_signature", "n_values"])
    return got.join(materialize(run_aggregates(spark, sf_dir)), "path_signature").select("id", "mean", "max", "std", "range", "value_rank")


@Q.query(with_views("SELECT id, coalesce(start_time, (SELECT median(start_time) FROM parts)) AS start_time, coalesce(end_time, (SELECT median(end_time) FROM parts)) AS end_time FROM parts", "parts"))
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.median_filled(V.parts(spark, sf_dir), ["start_time", "end_time"]).select("id", "start_time", "end_time")


@Q.query(with_views("SELECT id, CAST(round_even(coalesce(feature_mean, 0), 0) AS INTEGER) AS feature_mean, CAST(-1 AS DOUBLE) AS missing_column, coalesce(start_time, CAST(-9 AS DOUBLE)) AS start_time, path_signature FROM parts", "parts"))
def contract_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aligned(V.parts(spark, sf_dir), [("id", "bigint", 0), ("feature_mean", "int", 0), ("missing_column", "double", -1.0), ("start_time", "double", -9.0), ("path_signature", "string", "unknown_path")])


SHARES = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
MEASURES = ("value", "t", "price")


@Q.query(with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({s} AS DOUBLE) AS share, {q6(f'quantile_cont({c}, {s})')} AS value FROM measured" for c in MEASURES for s in SHARES), "readings", more="measured AS (SELECT value, t, CAST(NULL AS DOUBLE) AS price FROM readings UNION ALL SELECT NULL, NULL, o_totalprice FROM orders)"))
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of three columns: from places, not from all values in one aggregate."""
    r = V.readings(spark, sf_dir).select("value", "t").unionByName(V.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price")), allowMissingColumns=True)
    return quantized(quantiles(r, MEASURES, SHARES), "value")
