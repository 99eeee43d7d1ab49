"""Evaluation of scores: sweeps, budgets, policies, ranking statistics, costs and drift.

Scores are integers q on a fixed grid (pred = q / scale), so every engine and every cut agrees.
One grouped pass counts rows and positives at each score; all tables that need an order work on
these counts, of which there are at most scale + 1, never on the rows. Ranking statistics and
distances take any other score or column as well (`score`, grid=False): distinct values are
then as many as there may be, and are put in order by ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.exprs import balance, budget_rows, cost, mcc, ratio
from faultline.sources.scratch import materialize

from .ordered import lagged, running

SCALE = 10_000


def score_counts(scored: DataFrame, label: str = "response", *by: str, score: str = "q") -> DataFrame:
    """score, n, pos (and by): rows and positives at each score."""
    return scored.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))


def cumulated(counts: DataFrame, *by: str, score: str = "q", grid: bool = True) -> DataFrame:
    """counts with tp and m: positives and rows at the score or above."""
    if grid:  # the grid bounds the number of rows, so it is an error to leave it
        on = F.col(score).isNull() | (F.col(score).between(0, SCALE) & (F.col(score) == F.floor(score)))
        counts = counts.withColumn(score, F.when(on, F.col(score)).otherwise(F.raise_error(F.concat(F.lit(f"{score} isn't a whole number from 0 to {SCALE}: "), F.col(score).cast("string"))).cast(counts.schema[score].dataType)))
        w = Window.partitionBy(*by).orderBy(F.desc(score))
        return counts.withColumns({"tp": F.sum("pos").over(w), "m": F.sum("n").over(w)})
    return running(counts, [F.desc(score)], {"tp": F.col("pos"), "m": F.col("n")}, None, by)


def with_metrics(df: DataFrame) -> DataFrame:
    """df of tp, fp, fn, tn with precision, recall, mcc and the share of flagged rows in percent."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "mcc": mcc(tp, fp, fn, tn), "positives_pct": 100 * ratio(tp + fp, tp + fp + fn + tn)})


def confusion(rows: DataFrame, decision: Column, *by: str, label: str = "response") -> DataFrame:
    y, d = F.col(label) == 1, decision == 1
    return rows.groupBy(*by).agg(F.count_if(y & d).alias("tp"), F.count_if(~y & d).alias("fp"), F.count_if(y & ~d).alias("fn"), F.count_if(~y & ~d).alias("tn"))


def threshold_sweep(scored: DataFrame, label: str = "response", steps: int = 100) -> DataFrame:
    """A row for each threshold i / steps, 0 < i < steps, from cumulative counts of one pass."""
    spark, width = scored.sparkSession, SCALE // steps
    at = score_counts(scored, label).groupBy(F.floor(F.col("q") / width).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = at.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    grid = spark.range(1, steps).select(F.col("id").cast("int").alias("i"))
    got = grid.join(F.broadcast(at), F.col("k") >= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("flagged"), F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"))
    got = got.join(F.broadcast(total)).select(
        (F.col("i") / float(steps)).alias("threshold"), "tp", (F.col("flagged") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_n") - F.col("all_pos") - F.col("flagged") + F.col("tp")).alias("tn"))
    return with_metrics(got)


def best_threshold(scored: DataFrame, label: str = "response") -> DataFrame:
    """The threshold of highest MCC, the lowest of equals."""
    return threshold_sweep(scored, label).orderBy(F.desc("mcc"), "threshold").limit(1)


def ranked(scored: DataFrame, key: str = "id") -> DataFrame:
    """scored with rank (1 for the highest score, ties by key)."""
    return running(scored, [F.desc("q"), F.col(key)], position="rank").withColumn("rank", F.col("rank") + 1)


def top_counts(scored: DataFrame, sizes: Sequence[int], label: str = "response", key: str = "id") -> DataFrame:
    """For each size k of at least 1: k, q (the score of the k-th row, ties by key) and tp (positives among the first k).

    Counts at each score tell where the k-th row is; only the rows of those few scores are put in order.
    Rows without a score come last.
    """
    spark = scored.sparkSession
    grid = spark.createDataFrame([(int(k),) for k in set(sizes)], "k long")
    counts = cumulated(score_counts(scored, label))
    cuts = materialize(counts.join(F.broadcast(grid), (F.col("m") >= F.col("k")) & (F.col("m") - F.col("n") < F.col("k"))).select("k", "q", (F.col("tp") - F.col("pos")).alias("above"), (F.col("k") - F.col("m") + F.col("n")).alias("need")))
    # As many cuts as sizes.
    at_cut = scored.select(key, "q", label).join(F.broadcast(cuts.select(F.col("q").alias("__q")).distinct()), F.col("q").eqNullSafe(F.col("__q")), "left_semi")
    tied = running(at_cut, [F.col(key)], {"__tp": F.col(label).cast("long")}, "__r", ["q"])
    at = tied.join(F.broadcast(cuts.select("k", F.col("q").alias("__q"), "need")), F.col("q").eqNullSafe(F.col("__q"))).where(F.col("__r") + 1 == F.col("need")).select("k", "__tp")
    return cuts.join(F.broadcast(at), "k").select("k", "q", (F.col("above") + F.col("__tp")).alias("tp"))


def budget_curve(scored: DataFrame, percents: Sequence[int] = range(1, 11), label: str = "response") -> DataFrame:
    """What inspecting the top p percent of rows finds; ties by id. Rows without a score come last; a budget that ends among them has no cut-off (null)."""
    n, all_pos = scored.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    sizes = [(float(p), min(max(0, -(-n * p // 100)), n)) for p in percents]
    grid = scored.sparkSession.createDataFrame(sizes, "inspection_budget_pct double, selected_rows long")
    top = top_counts(scored, [k for _, k in sizes if k], label)
    got = grid.join(F.broadcast(top), F.col("k") == F.col("selected_rows"), "left")
    got = got.select("inspection_budget_pct", "selected_rows", (F.when(F.col("k").isNull(), F.lit(SCALE)).otherwise(F.col("q")) / float(SCALE)).alias("score_cutoff"), F.coalesce("tp", F.lit(0)).cast("long").alias("tp"))
    got = got.select("*", (F.col("selected_rows") - F.col("tp")).alias("fp"), (F.lit(all_pos) - F.col("tp")).alias("fn"), (F.lit(n - all_pos) - F.col("selected_rows") + F.col("tp")).alias("tn"))
    return with_metrics(got)


def hybrid(scored: DataFrame, threshold: int, percent: float, *by: str, key: str = "id") -> DataFrame:
    """auto_reject, manual_inspect and decision in each group of `by`: all at the threshold or above,
    then the best of the rest as far as the budget goes that the first have left. Rows without a score come last."""
    auto = F.coalesce(F.col("q") >= threshold, F.lit(False)).cast("int")
    got = scored.withColumn("auto_reject", auto)
    if by:
        w = Window.partitionBy(*by)
        got = got.withColumns({"__room": F.greatest(F.lit(0), budget_rows(F.count("*").over(w), F.lit(percent)) - F.sum("auto_reject").over(w)), "__rank": F.row_number().over(Window.partitionBy(*by, "auto_reject").orderBy(F.desc("q"), key))})
    else:
        n, autos = got.agg(F.count("*"), F.sum("auto_reject")).first()
        room = max(0, -int(-n * percent // 100) - (autos or 0))
        rest = ranked(got, key).withColumn("__rank", F.col("rank") - F.lit(autos or 0)).drop("rank")  # autos rank first
        got = rest.withColumn("__room", F.lit(room))
    manual = ((F.col("auto_reject") == 0) & (F.col("__rank") <= F.col("__room"))).cast("int")
    return got.withColumn("manual_inspect", manual).withColumn("decision", F.greatest("auto_reject", "manual_inspect")).drop("__room", "__rank")


def top_k(scored: DataFrame, percent: float, key: str = "id") -> DataFrame:
    n = scored.count()
    return ranked(scored, key).withColumn("decision", (F.col("rank") <= -int(-n * percent // 100)).cast("int")).drop("rank")


def cost_table(df: DataFrame) -> DataFrame:
    """df of tp, fp, fn, tn with total cost and cost for 100,000 rows."""
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return df.withColumn("total_cost", cost(F.col("fp"), F.col("fn"))).withColumn("cost_per_100k_rows", F.col("total_cost") / rows * 100000.0)


def operating_points(curve: DataFrame) -> DataFrame:
    """The cheapest row, the one of best recall within budgets of 1, 5 and 10 percent, and the best balance of precision and recall.

    curve: a table of few rows with metrics, costs and positives_pct. A category without a row is marked unavailable.
    """
    c = curve.withColumn("balance_score", balance(F.col("precision"), F.col("recall")))
    spec = [("min_cost", F.lit(True), [F.asc("total_cost"), F.desc("recall"), F.asc("threshold")]), *[(f"best_recall_{b}pct", F.col("positives_pct") <= b, [F.desc("recall"), F.desc("precision"), F.asc("threshold")]) for b in (1, 5, 10)], ("best_balance", F.lit(True), [F.desc("balance_score"), F.desc("mcc"), F.asc("threshold")])]
    out = None
    for name, ok, order in spec:
        got = c.where(ok).orderBy(*order).limit(1).withColumn("category", F.lit(name))
        out = got if out is None else out.unionByName(got)
    names = curve.sparkSession.createDataFrame([(s[0],) for s in spec], "category string")
    return names.join(F.broadcast(out), "category", "left").withColumn("available", F.col("threshold").isNotNull())


def recall_at_precision(sweep: DataFrame, targets: Sequence[float]) -> DataFrame:
    """For each target, the row of best recall (then precision, then low threshold) whose precision reaches it."""
    grid = sweep.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    got = grid.join(F.broadcast(sweep), F.col("precision") >= F.col("target"), "left")
    w = Window.partitionBy("target").orderBy(F.desc("recall"), F.desc("precision"), "threshold")
    return got.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").withColumn("available", F.col("threshold").isNotNull())


def roc_auc(scored: DataFrame, *by: str, label: str = "response", score: str = "q", grid: bool = True) -> DataFrame:
    """Area under the ROC curve; ties count half. Null with one class only."""
    c = cumulated(score_counts(scored, label, *by, score=score), *by, score=score, grid=grid)
    got = c.groupBy(*by).agg(F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return got.withColumn("auc", F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), F.col("u") / (F.col("p") * (F.col("n") - F.col("p"))).cast("double"))).drop("u")


def average_precision(scored: DataFrame, label: str = "response", *, score: str = "q", grid: bool = True) -> DataFrame:
    """Average precision over distinct scores, prevalence and lift."""
    c = cumulated(score_counts(scored, label, score=score), score=score, grid=grid)
    got = c.agg(F.sum(F.col("pos") * (F.col("tp") / F.col("m"))).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    got = got.select(ratio(F.col("s"), F.col("p")).alias("average_precision"), ratio(F.col("p"), F.col("n")).alias("prevalence"))
    return got.withColumn("lift", ratio(F.col("average_precision"), F.col("prevalence")))


def top_lift(scored: DataFrame, permille: Sequence[int], label: str = "response") -> DataFrame:
    """Precision, recall and lift of the top rows; at least one row is taken."""
    n, p = scored.agg(F.count("*"), F.sum(label)).first()
    ks = [(m / 10.0, min(n, max(1, -(-n * m // 1000)))) for m in permille] if n else []
    grid = scored.sparkSession.createDataFrame(ks, "top_pct double, k long")
    got = grid.join(F.broadcast(top_counts(scored, [k for _, k in ks], label)), "k").select("top_pct", "k", F.col("tp").cast("long").alias("tp"))
    got = got.withColumns({"precision": ratio(F.col("tp"), F.col("k")), "recall": ratio(F.col("tp"), F.lit(p or 0))})
    return got.withColumn("lift", ratio(F.col("precision"), F.lit((p or 0) / n if n else 0.0)))


def calibration(scored: DataFrame, bins: int = 10, label: str = "response") -> DataFrame:
    """Mean score and share of positives of each non-empty bin; a score on an inner edge belongs to the lower bin."""
    width = SCALE // bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("q") / width) - 1)).cast("int")
    return score_counts(scored, label).groupBy(b.alias("bin")).agg(F.sum("n").alias("n"), (F.sum(F.col("q") * F.col("n")) / F.sum("n") / float(SCALE)).alias("mean_score"), (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def brier(scored: DataFrame, label: str = "response") -> DataFrame:
    """Mean squared difference of score and label; summed in integers."""
    c = score_counts(scored, label)
    s = F.sum((F.lit(SCALE) - F.col("q")).cast("long") ** 2 * F.col("pos") + F.col("q").cast("long") ** 2 * (F.col("n") - F.col("pos")))
    return c.agg((s / F.sum("n") / float(SCALE) ** 2).alias("brier"), F.sum("n").alias("n"))


def distance(reference: DataFrame, current: DataFrame, column: str = "q", scale: float = SCALE) -> DataFrame:
    """Wasserstein distance (and over the reference's standard deviation) and Kolmogorov-Smirnov distance of a numeric column in two tables, in units of 1 / scale.

    Nulls and NaN are left out. Both tables are summed up by distinct values, which are put in
    order by ranges, however many there are.
    """
    def of(df: DataFrame, name: str, other: str) -> DataFrame:
        return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).alias("v")).agg(F.count("*").alias(name)).withColumn(other, F.lit(0).cast("long"))

    both = of(reference, "a", "b").unionByName(of(current, "b", "a")).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = materialize(lagged(running(both, [F.col("v")], {"ca": F.col("a"), "cb": F.col("b")}), "pos", {"after": (F.col("v"), -1)}))
    n = F.broadcast(placed.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    x = F.col("v").cast("double")
    std = F.sqrt(F.sum(F.col("a") * x**2) / F.sum("a") - (F.sum(F.col("a") * x) / F.sum("a")) ** 2)
    got = placed.join(n).agg((F.sum(gap * F.coalesce(F.col("after") - F.col("v"), F.lit(0))) / float(scale)).alias("wasserstein"), F.max(gap).alias("ks"), (std / float(scale)).alias("reference_std"))
    return got.withColumn("normalized", ratio(F.col("wasserstein"), F.col("reference_std")))


def nearest_row(grid: DataFrame, column: str, value: float) -> DataFrame:
    """The row of a table of few rows whose column is nearest to a value, the smaller one of equals."""
    return grid.where(F.col(column).isNotNull()).orderBy(F.abs(F.col(column) - F.lit(float(value))), column).limit(1)


def source_scores(sources: Mapping[str, DataFrame], threshold: float, score: str = "pred", label: str = "response") -> DataFrame:
    """source, place (in the order given) and MCC at the threshold, of each source of scores."""
    out = None
    for k, (name, rows) in enumerate(sources.items()):
        got = with_metrics(confusion(rows, (F.col(score) >= threshold).cast("int"), label=label)).select(F.lit(name).alias("source"), F.lit(k).alias("place"), "mcc")
        out = got if out is None else out.unionByName(got)
    return out


def best_source(sources: Mapping[str, DataFrame], threshold: float = 0.74, score: str = "pred", label: str = "response") -> tuple[str, float]:
    """Name and MCC of the source of highest MCC at the threshold, the first of equals; an error without any source."""
    if not sources:
        raise FileNotFoundError("there are no scores to pick from")
    best = source_scores(sources, threshold, score, label).orderBy(F.desc("mcc"), "place").first()
    return best.source, best.mcc


def checked_policy(threshold: float, percent: float) -> tuple[float, float]:
    """Threshold (0 to 1) and budget in percent (0 to 100), or an error."""
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} isn't within 0 and 1")
    if not 0 <= percent <= 100:
        raise ValueError(f"budget {percent} isn't within 0 and 100 percent")
    return threshold, percent


def predict_actions(scores: DataFrame, threshold: float, score: str = "pred") -> DataFrame:
    """scores with decision and action at the threshold; an error if a score isn't within 0 and 1 (this runs a job)."""
    checked_policy(threshold, 0)
    bad = scores.where(F.col(score).isNull() | F.isnan(score) | (F.col(score) < 0) | (F.col(score) > 1)).count()
    if bad:
        raise ValueError(f"{bad} scores aren't within 0 and 1")
    d = (F.col(score) >= threshold).cast("int")
    return scores.withColumns({"decision": d, "action": F.when(d == 1, "auto_reject").otherwise("pass")})


def batch_predict(scored: DataFrame, threshold: float, percent: float, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(decisions of the hybrid policy, one row of its counts) for scores q on the grid; an error for an empty table."""
    checked_policy(threshold, percent)
    if scored.isEmpty():
        raise ValueError("there are no scores")
    got = hybrid(scored, round(threshold * SCALE), percent, key=key)
    counts = got.agg(F.count("*").alias("rows"), F.sum("auto_reject").alias("auto_reject_count"), F.sum("manual_inspect").alias("manual_inspection_count"))
    return got, counts.select(F.lit(float(threshold)).alias("threshold_high"), F.lit(float(percent)).alias("inspection_budget_pct"), "*")
