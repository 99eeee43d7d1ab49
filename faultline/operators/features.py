"""Part-level features from times, readings and paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.exprs import pairs, shift_bucket, smoothed, tokens, transitions
from faultline.sources.scratch import materialize

from .ordered import asof_backward, joined, lagged, lagged_mean, placed_counts, quantiles, running, sorted_rows, time_counts
from .wide import dealt


def filled_start(parts: DataFrame, t: str = "start_time", key: str = "id") -> DataFrame:
    """parts with missing times one unit before the first; without any time, places in the order of the key."""
    first = parts.agg(F.min(t)).first()[0]
    if first is None:
        return running(parts, [F.col(key)], position="__pos").withColumn(t, F.col("__pos").cast("double")).drop("__pos")
    return parts.withColumn(t, F.coalesce(F.col(t), F.lit(first - 1.0)))


def time_blocks(parts: DataFrame, size: int, t: str = "start_time", key: str = "id") -> DataFrame:
    """time_block: blocks of `size` rows in the order of (t, key); and block_size."""
    return _blocked(running(parts, [F.col(t), F.col(key)], position="__pos"), size, parts.count())


def _blocked(placed: DataFrame, size: int, n: int) -> DataFrame:
    """All blocks but the last are full."""
    block = F.floor(F.col("__pos") / size).cast("int")
    return placed.withColumn("time_block", block).withColumn("block_size", F.least(F.lit(size), F.lit(n) - F.col("time_block") * size).cast("long")).drop("__pos")


#: Widths of the sliding counts of the core features.
RECENT = {"records_last_1hr": 1.0, "records_last_24hr": 24.0}


def core_features(parts: DataFrame, *, block: int = 10_000) -> DataFrame:
    """The eight core features: times, mean, sliding counts of 1 and 24 units, their ratio, time block."""
    parts = materialize(parts)
    timed = time_counts(filled_start(parts), "start_time", "id", RECENT, "__pos")
    return _blocked(timed.withColumn("density_ratio", density()), block, parts.count())


def density() -> Column:
    return F.col("records_last_1hr") / F.greatest(F.col("records_last_24hr"), F.lit(1))


def placed_core(starts: DataFrame, parts: DataFrame) -> DataFrame:
    """Core features but for the time block, of rows that run_starts has put in the order of (start_time, id): nulls, last there, come first here."""
    n, empty, first = parts.agg(F.count("*"), F.count_if(F.col("start_time").isNull()), F.min("start_time")).first()
    pos = F.pmod(F.col("__pos") + F.lit(empty), F.lit(max(1, n)))
    filled = F.coalesce(F.col("start_time").cast("double"), pos.cast("double") if first is None else F.lit(float(first) - 1.0))
    got = placed_counts(starts.withColumns({"__when": pos, "start_time": filled}), "start_time", "__when", RECENT)
    return got.withColumn("density_ratio", density())


#: Units of the time proxies, and row windows of the legacy block.
WEEK, DAY, HOUR, HOURS = 1680, 240, 10, 24
LEGACY = (25, 240, 1680)


def medians(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> dict[str, float]:
    """Exact medians of columns, 0 for one without a value; a row counts as often as its `weight` says."""
    known = {r.column_name: r.value for r in quantiles(rows, columns, [0.5], weight=weight).collect()} if columns else {}
    return {c: float(known.get(c, 0.0)) for c in columns}


def duration_stats(parts: DataFrame, column: str = "duration") -> dict[str, float]:
    """Mean, sample deviation (1 where it isn't positive), 10th and 90th percentile of a column; 0 without a value."""
    r = parts.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    q = {x.share: float(x.value) for x in quantiles(parts, [column], [0.1, 0.9]).collect()}
    return {"mean": float(r.m or 0.0), "std": float(r.s) if r.s and r.s > 0 else 1.0, "low": q.get(0.1, 0.0), "high": q.get(0.9, 0.0)}


def date_features(parts: DataFrame, stats: Mapping[str, float], t: str = "start_time", column: str = "duration") -> DataFrame:
    """parts with the place of their time in the week, day and hour of the time proxies, and what fitted stats say of their duration."""
    at, d = F.col(t), F.col(column)
    return parts.withColumns({
        "in_week": F.pmod(at, F.lit(float(WEEK))), "day": F.pmod(F.floor(at / DAY), F.lit(7)).cast("int"), "hour": F.pmod(F.floor(at / HOUR), F.lit(HOURS)).cast("int"), "log_duration": F.log1p(column),
        "z_duration": (d - F.lit(stats["mean"])) / F.lit(stats["std"]), "is_long": (d > F.lit(stats["high"])).cast("int"), "is_short": (d < F.lit(stats["low"])).cast("int"),
    })


def legacy_features(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with the legacy block, which takes ids for times: rows in windows before and after, place in the week, shift."""
    n = rows.count()
    got = running(rows, [F.col(key)], position="__pos")
    windows = {k: c for w in LEGACY for k, c in ((f"last_{w}", F.least(F.col("__pos") + 1, F.lit(w)).cast("long")), (f"next_{w}", F.least(F.lit(n) - F.col("__pos"), F.lit(w)).cast("long")))}
    return got.withColumns(windows | _id_times(key)).drop("__pos")


def legacy_past(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows with what looks back in the legacy block of `ids`: last_w, week_part, shift. Only the first of all have fewer before them than a window, so only these are put in order."""
    few = ids.select(F.col(key).alias("__first")).orderBy("__first").limit(max(LEGACY)).withColumn("__nth", F.row_number().over(Window.orderBy("__first")) - 1)
    got = rows.join(F.broadcast(few.groupBy("__first").agg(F.max("__nth").alias("__nth"))), F.col(key) == F.col("__first"), "left")
    windows = {f"last_{w}": F.coalesce(F.least(F.col("__nth") + 1, F.lit(w)), F.lit(w)).cast("long") for w in LEGACY}
    return got.withColumns(windows | _id_times(key)).drop("__first", "__nth")


def _id_times(key: str) -> dict[str, Column]:
    """The legacy block's place in the week and shift."""
    return {"week_part": F.pmod(key, F.lit(WEEK)).cast("int"), "shift": shift_bucket(F.pmod(F.floor(F.col(key) / HOUR), F.lit(HOURS)))}


def station_means(readings: DataFrame, stations: Sequence[str]) -> DataFrame:
    """A column for each station with the mean of a part's readings there; null where it wasn't."""
    return dealt(readings.select("id", "station", "value")).groupBy("id").pivot("station", list(stations)).agg(F.avg("value"))


def other_folds(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Each row once for every fold that it isn't in: what is learned for a fold is then a group of `fold`."""
    return rows.withColumn(fold, F.explode(F.filter(F.array(*map(F.lit, range(folds))), lambda k: k != F.col(fold)).cast(f"array<{rows.schema[fold].dataType.simpleString()}>")))


def path_lookup(paths: DataFrame, *, label: str = "response", signature: str = "path_signature", fold: str | None = None, folds: int = 5) -> dict[str, DataFrame]:
    """Station and transition rates, pair and path counts; with `fold`, for each fold from the rows of all others.

    Signatures are summed up first, so tokens are cut once each and folds repeat sums, not rows.
    """
    key = [fold] if fold else []
    sums = paths.groupBy(*key, signature).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    if fold:
        sums = other_folds(sums, fold, folds).groupBy(fold, signature).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    sums = materialize(sums).withColumn("path", tokens(F.col(signature)))

    def rate(items: Column) -> DataFrame:
        got = sums.select(*key, F.explode(items).alias("token"), "pos", "n").groupBy(*key, "token").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        return got.withColumn("rate", F.col("pos") / F.col("n"))

    return {
        "station": rate(F.col("path")), "transition": rate(transitions(F.col("path"))),
        "pair": sums.select(*key, F.explode(pairs(F.col("path"))).alias("token"), "n").groupBy(*key, "token").agg(F.sum("n").alias("n")),
        "path": sums.select(*key, signature, "pos", "n"),
    }


def path_features(paths: DataFrame, lookup: dict[str, DataFrame], overall: float | None, *, signature: str = "path_signature", fold: str | None = None) -> DataFrame:
    """paths with what the lookup says of each signature. Unknown stations and transitions have the
    overall rate, unknown pairs are skipped, unknown paths count 1. Computed once for each signature.
    """
    key = [*([fold] if fold else []), signature]
    sig = paths.select(*key).distinct().withColumn("path", tokens(F.col(signature)))
    g = F.lit(overall).cast("double")

    def of(items: Column, known: DataFrame, value: str, *aggs: Column) -> DataFrame:
        got = sig.select(*key, F.explode(items).alias("token")).join(known.select(*key[:-1], "token", F.col(value).cast("double").alias("v")), [*key[:-1], "token"], "left")
        return got.groupBy(*key).agg(*aggs)

    v = F.coalesce("v", g)
    t = of(transitions(F.col("path")), lookup["transition"], "rate", F.avg(v).alias("transition_mean"), F.max(v).alias("transition_max"), F.stddev_pop(v).alias("transition_std"))
    s = of(F.col("path"), lookup["station"], "rate", F.avg(v).alias("station_mean"))
    p = of(pairs(F.col("path")), lookup["pair"], "n", F.avg("v").alias("pair_mean"), F.max("v").alias("pair_max"), F.stddev_pop("v").alias("pair_std"))
    got = sig.join(t, key, "left").join(s, key, "left").join(p, key, "left").join(lookup["path"], key, "left")
    got = got.select(
        *key, F.coalesce("transition_mean", g).alias("transition_fail_rate_mean"), F.coalesce("transition_max", g).alias("transition_fail_rate_max"), F.coalesce("transition_std", F.lit(0.0)).alias("transition_fail_rate_std"),
        F.coalesce("station_mean", g).alias("station_risk_mean"), F.coalesce("n", F.lit(1)).alias("path_count"),
        *[F.coalesce(f"pair_{x}", F.lit(0.0)).alias(f"pair_cooccur_{x}") for x in ("mean", "max", "std")],
    )
    return paths.join(got, key)


def smoothed_rates(rows: DataFrame, by: str, label: str = "response", m: float = 10.0) -> DataFrame:
    """by, n and the rate of label shrunk towards the overall rate."""
    overall = rows.agg(F.avg(label)).first()[0]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(label).alias("r")).withColumn("rate", smoothed(F.col("n"), F.col("r"), F.lit(overall), m))


def target_encoded(rows: DataFrame, fit: DataFrame, by: str, name: str, label: str = "response") -> DataFrame:
    """rows with the mean label that their `by` has in fit; what fit doesn't know, and null, has the overall mean."""
    overall = fit.agg(F.avg(label)).first()[0]
    known = fit.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(label).alias("__rate"))
    return rows.join(known, by, "left").withColumn(name, F.coalesce("__rate", F.lit(overall))).drop("__rate")


def rolling_rate(train: DataFrame, probes: DataFrame, overall: float, *, rows: int = 10_000, t: str = "start_time", key: str = "id", label: str = "response", name: str = "rolling_fail_rate", by: Sequence[str] = ()) -> DataFrame:
    """probes with the rate over the `rows` train rows before the last one at or before their time; else the overall rate."""
    past = lagged_mean(train.where(F.col(t).isNotNull()).select(*by, t, key, label), [F.col(t), F.col(key)], F.col(label), rows, name, by)
    past = past.withColumn(name, F.coalesce(name, F.lit(overall)))
    return asof_backward(probes, past.select(*by, t, key, name).withColumnRenamed(key, "__key"), t, [name], F.col("__key"), {name: F.lit(overall)}, by)


def since_failures(parts: DataFrame, ks: Sequence[int] = (1, 5, 10), *, t: str = "end_time", key: str = "id", label: str = "response", failure_t: str = "end_time", failures: DataFrame | None = None) -> DataFrame:
    """parts with since_k: their time less the mean time of the last k failures strictly before it; null with fewer. With `failures` only that table's failures count.

    Failures are few against the rows: they are numbered and summed up in time order (times to
    nine decimal places), each gets the mean of the k that end with it, and each part looks up
    the last one before it.
    """
    failed = (parts if failures is None else failures).where((F.col(label) == 1) & F.col(failure_t).isNotNull()).select(F.col(failure_t).alias("__t"), F.col(key).alias("__key"))
    # Decimals: the difference of two long sums of doubles would have lost what the times differ by.
    exact = F.col("__t").cast("decimal(38,9)")
    summed = lagged(running(failed, [F.col("__t"), F.col("__key")], {"__sum": exact}, "__i"), "__i", {f"__s{k}": (F.col("__sum"), k) for k in ks})
    means = [F.when(F.col("__i") >= k - 1, (F.col("__sum") - F.coalesce(F.col(f"__s{k}"), F.lit(0).cast("decimal(38,9)"))).cast("double") / k).alias(f"__m{k}") for k in ks]
    names = [f"__m{k}" for k in ks]
    got = asof_backward(parts, summed.select(F.col("__t").alias(t), "__i", *means), t, names, F.col("__i"), strict=True)
    return got.withColumns({f"since_{k}": F.col(t) - F.col(f"__m{k}") for k in ks}).drop(*names)


def median_filled(rows: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """rows with nulls replaced by the exact medians of fit (or of rows); 0 where a column has no value."""
    m = medians(rows if fit is None else fit, columns)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(m[c])) for c in columns})


def aligned(rows: DataFrame, contract: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Exactly the columns of the contract (name, type, fill), in its order: missing ones are made, others go, nulls are filled; integers are rounded half to even."""
    have, whole = dict(rows.dtypes), ("int", "bigint", "smallint", "tinyint")
    out = []
    for name, kind, fill in contract:
        c = F.col(name) if name in have else F.lit(None)
        if kind in whole and have.get(name) not in whole:
            c = F.bround(c.cast("double"))
        out.append(F.coalesce(c.cast(kind), F.lit(fill).cast(kind)).alias(name))
    return rows.select(*out)


def duplicate_runs(rows: DataFrame, same: Sequence[str], t: str, key: str) -> DataFrame:
    """rows with dup_run (1-based number of the run of equal `same` in the order of (t, key), nulls last), its size, and ranks from both ends.

    Rows are sorted once. The first row of a range sees the last one of the range before; a
    range's runs, places and ends go on in those beside it by a table with a row for each range.
    """
    return run_ranks(run_starts(rows, same, t, key)).select(*rows.columns, "dup_run", "run_size", "run_rank", "run_rank_desc")


def run_starts(rows: DataFrame, same: Sequence[str], t: str, key: str) -> DataFrame:
    """rows as written in the order of duplicate_runs: __range, __place, __pos (place among all), __new (a run begins) and __all (rows)."""
    got = sorted_rows(rows, [F.col(t).asc_nulls_last(), F.col(key)]).withColumn("__same", F.struct(*same))
    ranges, w = Window.orderBy("__range"), Window.partitionBy("__range").orderBy("__place")
    ends = got.groupBy("__range").agg(F.max_by("__same", "__place").alias("__end"), F.count("*").alias("__n"))
    ends = ends.select("__range", F.lag("__end").over(ranges).alias("__before"), (F.sum("__n").over(ranges) - F.col("__n")).alias("__ahead"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    got = joined(got, ends, ["__range"]).withColumn("__pos", F.col("__ahead") + F.col("__place"))
    before = F.when(F.col("__place") == 0, F.col("__before")).otherwise(F.lag("__same").over(w))
    return materialize(got.withColumn("__new", (F.col("__pos") == 0) | ~F.col("__same").eqNullSafe(before)).drop("__same", "__before", "__ahead"))


def run_ranks(got: DataFrame) -> DataFrame:
    """dup_run, run_size, run_rank and run_rank_desc of what run_starts gives."""
    ranges, w = Window.orderBy("__range"), Window.partitionBy("__range").orderBy("__place")
    start = F.when(F.col("__new"), F.col("__pos"))
    runs = got.groupBy("__range").agg(F.count_if("__new").alias("__n"), F.min(start).alias("__low"), F.max(start).alias("__high"))
    # What follows is seen in descending order: a frame that shrinks from row to row would be gone through anew for each.
    past, ahead = ranges.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__range", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n"), F.max("__high").over(past).alias("__high"), F.min("__low").over(ahead).alias("__low"))
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("__range").orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, -1)
    got = joined(got.withColumns({"dup_run": F.sum(F.col("__new").cast("long")).over(upto), "__start": F.max(start).over(upto), "__next": F.min(start).over(after)}), runs, ["__range"])
    first, end = F.coalesce("__start", "__high"), F.coalesce("__next", "__low", "__all")
    return got.withColumns({"dup_run": F.col("dup_run") + F.col("__n"), "run_size": end - first, "run_rank": F.col("__pos") - first + 1, "run_rank_desc": end - F.col("__pos")})


def run_neighbours(rows: DataFrame, by: str, key: str, value: str, size: str) -> DataFrame:
    """rows with what their group of `by` says in the order of the key: pos, n, prev and next value, past_mean of `size` (integers), position_ratio; and value_rank by size, largest first."""
    counts = materialize(rows.groupBy(by).agg(F.count("*").alias("n")))
    placed = running(rows, [F.col(key)], {"__sum": F.col(size).cast("long")}, by=[by])
    placed = lagged(placed, "pos", {"prev": (F.col(value), 1), "next": (F.col(value), -1), "__past": (F.col("__sum"), 1)}, [by])
    ranked = running(placed, [F.desc(size), F.col(key)], position="__rank", by=[by])
    got = joined(ranked, counts, [by])
    return got.withColumns({"past_mean": F.col("__past") / F.col("pos"), "position_ratio": F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1)), "value_rank": F.col("__rank") + 1}).drop("__sum", "__past", "__rank")
