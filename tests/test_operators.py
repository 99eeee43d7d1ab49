"""Operators on small hand-made tables: ties, nulls, empties, fallbacks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import exprs as X
from faultline.operators import evaluate as E
from faultline.operators import features as ops
from faultline.operators import joins as J
from faultline.operators.folds import group_folds, leaks
from faultline.operators.drift import drift_report, drift_table
from faultline.operators.ordered import asof_backward, centered_counts, lagged, lagged_mean, quantiles, running, time_counts


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_time_counts_ties_see_earlier_rows_only(spark):
    t = [0.0, 0.0, 0.0, 1.0, 1.0, 25.0]
    df = spark.createDataFrame(list(enumerate(t)), "id long, t double")
    got = sorted(rows(time_counts(df, "t", "id", {"a": 1.0, "b": 24.0}), "id", "a", "b"))
    assert got == [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4), (4, 5, 5), (5, 1, 3)]


def test_time_counts_random_against_two_pointers(spark):
    rng = random.Random(1)
    t = sorted(rng.randint(-40, 60) / 2 for _ in range(300))
    df = spark.createDataFrame(list(enumerate(t)), "id long, t double").repartition(5)
    got = sorted(rows(time_counts(df, "t", "id", {"a": 1.5, "b": 7.0}), "id", "a", "b"))
    assert got == [(i, sum(x >= t[i] - 1.5 for x in t[: i + 1]), sum(x >= t[i] - 7.0 for x in t[: i + 1])) for i in range(300)]


def test_centered_counts(spark):
    t = [0.0, 0.004, 0.0051, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(t)), "id long, t double")
    assert sorted(rows(centered_counts(df, "t", "n", 0.005), "id", "n")) == [(0, 1), (1, 2), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_and_lagged_mean(spark, partitions):
    rng = random.Random(2)
    data = [(i, float(rng.randint(0, 20)), rng.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, t double, y int").repartition(partitions)
    order = sorted(data, key=lambda r: (r[1], r[0]))
    got = {r.id: (r.pos, r.s) for r in running(df, [F.col("t"), F.col("id")], {"s": F.col("y")}).collect()}
    total = 0
    for k, (i, _, y) in enumerate(order):
        total += y
        assert got[i] == (k, total)
    mean = {r.id: r.m for r in lagged_mean(df, [F.col("t"), F.col("id")], F.col("y"), 5, "m", block=11).collect()}
    for k, (i, _, _) in enumerate(order):
        past = [y for _, _, y in order[max(0, k - 5) : k]]
        assert mean[i] == (pytest.approx(sum(past) / len(past)) if past else None)


def test_asof_last_of_ties_and_default(spark):
    keys = spark.createDataFrame([(1.0, 0, 10), (1.0, 1, 11), (2.5, 2, 12)], "t double, k long, v int")
    probes = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 0.5), (5, None)], "id long, t double")
    got = sorted(rows(asof_backward(probes, keys, "t", ["v"], F.col("k"), {"v": F.lit(-1)}), "id", "v"))
    assert got == [(1, 11), (2, 11), (3, 12), (4, -1), (5, -1)]


def test_filled_start(spark):
    some = spark.createDataFrame([(1, 5.0), (2, None)], "id long, start_time double")
    assert sorted(rows(ops.filled_start(some), "id", "start_time")) == [(1, 5.0), (2, 4.0)]
    none = spark.createDataFrame([(7, None), (3, None)], "id long, start_time double")
    assert sorted(rows(ops.filled_start(none), "id", "start_time")) == [(3, 0.0), (7, 1.0)]


def test_path_expressions(spark):
    df = spark.createDataFrame([(0, None), (1, "__none__"), (2, "a"), (3, "a|b"), (4, "a|b|c"), (5, "|a||b|")], "id long, p string")
    t = X.tokens(F.col("p"))
    got = sorted(rows(df.select("id", t.alias("t"), X.transitions(t).alias("x"), X.pairs(t).alias("y")), "id", "t", "x", "y"))
    assert got == [(0, [], [], []), (1, [], [], []), (2, ["a"], [], []), (3, ["a", "b"], ["a>b"], ["a&b"]), (4, ["a", "b", "c"], ["a>b", "b>c"], ["a&b", "a&c", "b&c"]), (5, ["a", "b"], ["a>b"], ["a&b"])]


def test_path_features_fallbacks(spark):
    train = spark.createDataFrame([("a|b", 1), ("a|b", 0), ("a", 0)], "path_signature string, response int")
    probe = spark.createDataFrame([(1, "a|b"), (2, "a|z"), (3, "__none__"), (4, "q")], "id long, path_signature string")
    got = {r.id: r for r in ops.path_features(probe, ops.path_lookup(train), 0.25).collect()}
    assert (got[1].transition_fail_rate_mean, got[1].path_count, got[1].pair_cooccur_mean) == (0.5, 2, 2.0)
    assert (got[2].transition_fail_rate_mean, got[2].path_count, got[2].pair_cooccur_mean) == (0.25, 1, 0.0)
    assert got[2].station_risk_mean == pytest.approx((1 / 3 + 0.25) / 2)
    assert (got[3].transition_fail_rate_max, got[3].transition_fail_rate_std, got[3].station_risk_mean, got[3].path_count) == (0.25, 0.0, 0.25, 1)
    assert got[4].station_risk_mean == 0.25


def test_since_failures(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 1, 3.0), (4, 0, 3.0), (5, 0, 4.0), (6, 0, None)], "id long, response int, end_time double")
    got = sorted(rows(ops.since_failures(df, (1, 2)), "id", "since_1", "since_2"))
    assert got == [(1, None, None), (2, None, None), (3, 2.0, None), (4, 2.0, None), (5, 1.0, 2.0), (6, None, None)]


def test_since_failures_at_fractional_times(spark):
    rng = random.Random(12)
    data = [(1, 1, 1.0), (2, 0, 1.1), *((i, int(rng.random() < 0.3), rng.randrange(100, 200) / 100) for i in range(3, 200))]
    df = spark.createDataFrame(data, "id long, response int, end_time double")
    got = {r.id: r for r in ops.since_failures(df, (1, 5, 10)).collect()}
    failed = sorted(t for _, y, t in data if y)
    for i, _, t in data:
        past = [x for x in failed if x < t]
        for k in (1, 5, 10):
            want = t - sum(past[-k:]) / k if len(past) >= k else None
            assert got[i][f"since_{k}"] == (None if want is None else pytest.approx(want, abs=1e-9)), (i, k)


def test_asof_strict_leaves_equal_keys_out(spark):
    keys = spark.createDataFrame([(1.0, 10), (1.01, 11), (1.01, 12), (2.5, 13)], "t double, v int")
    probes = spark.createDataFrame([(1, 1.0), (2, 1.01), (3, 1.02), (4, 2.5), (5, 9.0), (6, None)], "id long, t double")
    got = sorted(rows(asof_backward(probes, keys, "t", ["v"], F.col("v"), {"v": F.lit(0)}, strict=True), "id", "v"))
    assert got == [(1, 0), (2, 10), (3, 12), (4, 12), (5, 13), (6, 0)]


def test_duplicate_runs(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 0.0, "a"), (3, 1.0, "b"), (4, 2.0, "a"), (5, None, "a"), (6, None, None)], "id long, t double, v string")
    got = sorted(rows(ops.duplicate_runs(df, ["v"], "t", "id"), "id", "dup_run", "run_size", "run_rank", "run_rank_desc"))
    assert got == [(1, 1, 2, 1, 2), (2, 1, 2, 2, 1), (3, 2, 1, 1, 1), (4, 3, 2, 1, 2), (5, 3, 2, 2, 1), (6, 4, 1, 1, 1)]


SCORES = [(1, 9500, 1), (2, 9500, 0), (3, 7000, 1), (4, 3000, 0), (5, 3000, 1), (6, 100, 0)]


def scored(spark, data=SCORES):
    return spark.createDataFrame([(i, q, y, q / 10000) for i, q, y in data], "id long, q int, response int, pred double")


@pytest.mark.parametrize(("threshold", "percent", "auto", "manual"), [(9000, 50.0, {1, 2}, {3}), (9000, 10.0, {1, 2}, set()), (9900, 34.0, set(), {1, 2, 3}), (9900, 0.0, set(), set()), (0, 10.0, {1, 2, 3, 4, 5, 6}, set())])
def test_hybrid_counts_autos_first(spark, threshold, percent, auto, manual):
    s = scored(spark).withColumn("g", F.lit(1))
    for got in (E.hybrid(s, threshold, percent), E.hybrid(s, threshold, percent, "g")):
        r = got.collect()
        assert {x.id for x in r if x.auto_reject} == auto and {x.id for x in r if x.manual_inspect} == manual
        assert {x.id for x in r if x.decision} == auto | manual


def test_equal_scores_are_taken_by_id(spark):
    s = scored(spark, [(i, 500, 0) for i in range(10)])
    assert {r.id for r in E.top_k(s, 25.0).where("decision = 1").collect()} == {0, 1, 2}


def test_ranking_statistics_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 30) * 100, int(rng.random() < 0.3)) for i in range(150)]
    s = scored(spark, data)
    pos, neg = [q for _, q, y in data if y], [q for _, q, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(s).first().auc == pytest.approx(auc)
    ap = sum(sum(p == q for p in pos) * sum(p >= q for p in pos) / sum(x >= q for _, x, _ in data) for q in set(pos)) / len(pos)
    assert E.average_precision(s).first().average_precision == pytest.approx(ap)
    assert E.brier(s).first().brier == pytest.approx(sum((q / 10000 - y) ** 2 for _, q, y in data) / len(data))
    for r in E.threshold_sweep(s).collect():
        t = round(r.threshold * 100) * 100
        assert (r.tp, r.fp, r.fn, r.tn) == (sum(p >= t for p in pos), sum(n >= t for n in neg), sum(p < t for p in pos), sum(n < t for n in neg))


def test_one_class_and_zero_denominators(spark):
    s = scored(spark, [(1, 100, 0), (2, 9000, 0)])
    assert E.roc_auc(s).first().auc is None
    assert {(r.precision, r.recall, r.mcc) for r in E.threshold_sweep(s).collect()} == {(0.0, 0.0, 0.0)}
    assert E.average_precision(s).first().lift == 0.0


def test_scores_on_the_grid_and_bins(spark):
    s = scored(spark, [(1, 7000, 1), (2, 3000, 1), (3, 0, 0), (4, 10000, 1), (5, 1000, 0)])
    sweep = {round(r.threshold, 2): r.tp for r in E.threshold_sweep(s).collect()}
    assert sweep[0.7] == 2 and sweep[0.71] == 1 and sweep[0.3] == 3
    assert sorted(rows(E.calibration(s), "bin", "n")) == [(0, 2), (2, 1), (6, 1), (9, 1)]


def test_operating_points_without_rows(spark):
    sweep = E.cost_table(E.threshold_sweep(scored(spark)))
    got = {r.category: r.available for r in E.operating_points(sweep.where("positives_pct > 20")).collect()}
    assert got == {"min_cost": True, "best_recall_1pct": False, "best_recall_5pct": False, "best_recall_10pct": False, "best_balance": True}


def test_distance(spark):
    a, b = (spark.createDataFrame([(q,) for q in x], "q int") for x in ([0, 1000, 3000], [5000, 6000, 8000]))
    got = E.distance(a, b).first()
    assert got.wasserstein == pytest.approx(0.5) and got.ks == pytest.approx(1.0)


def test_expressions(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 8, 9, 16, 17, 24)], "h int")
    assert [r[0] for r in df.select(X.shift_bucket(F.col("h"))).collect()] == [None, 1, 1, 2, 2, 3, 3]
    assert spark.range(1).select(X.quantized(F.lit(164) / F.lit(2560))).first()[0] == math.floor(164 / 2560 * 1e6 + 0.5) / 1e6
    assert spark.range(1).select(X.mcc(F.lit(2), F.lit(1), F.lit(1), F.lit(6))).first()[0] == pytest.approx((12 - 1) / (3 * 3 * 7 * 7) ** 0.5)


def test_joins_refuse_what_they_must(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    b = spark.createDataFrame([(2,), (3,)], "id long")
    with pytest.raises(ValueError, match="left"):
        J.one_to_one(a, b, "id")
    assert sorted(rows(J.id_difference(a, b, "id"), "kind", "n")) == [("extra", 1), ("missing", 1)]
    with pytest.raises(ValueError, match="may not read"):
        J.refuse(a.withColumn("Response", F.lit(1)), "response")
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        J.require(a, "y", "x", "id")


def test_alignment_and_medians(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 1.5, 4.0), (3, None, 8.0)], "id long, a double, b double")
    got = ops.aligned(df, [("b", "double", -1.0), ("a", "int", 9), ("new", "string", "x"), ("id", "bigint", 0)])
    assert got.columns == ["b", "a", "new", "id"] and rows(got.orderBy("id"), "b", "a", "new") == [(-1.0, 0, "x"), (4.0, 2, "x"), (8.0, 9, "x")]
    assert rows(ops.median_filled(df, ["a", "b"]).orderBy("id"), "a", "b") == [(0.5, 6.0), (1.5, 4.0), (1.0, 8.0)]


def test_group_folds_are_whole_and_even(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, i // 10, int(rng.random() < 0.1)) for i in range(300)], "id long, g long, y int")
    got = group_folds(df, "g", "y", 5)
    assert leaks(got, "g", "cv_fold").where("leaks").count() == 0 and got.count() == 300
    sizes = [r.n for r in got.groupBy("cv_fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 30
    with pytest.raises(ValueError, match="groups"):
        group_folds(df.where("g < 3"), "g", "y", 5)


def test_ties_and_groups_are_cut_as_well(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i % 5), i % 2 or None, i) for i in range(300)], "id long, t double, g long, v long").repartition(5)
        got = {r.id: (r.pos, r.s) for r in running(df, [F.col("t"), F.col("id")], {"s": F.col("v")}, by=["g"]).collect()}
        for g in (None, 1):
            total = 0
            for k, (_, i) in enumerate(sorted((1.0 if i % 3 else float(i % 5), i) for i in range(300) if (i % 2 or None) == g)):
                total += i
                assert got[i] == (k, total)
        placed = running(df, [F.col("t"), F.col("id")], by=["g"])
        by = {(r.g, r.pos): r.v for r in placed.collect()}
        for r in lagged(placed, "pos", {"a": (F.col("v"), 3), "b": (F.col("v"), -2)}, ["g"], block=10).collect():
            assert (r.a, r.b) == (by.get((r.g, r.pos - 3)), by.get((r.g, r.pos + 2)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_float_scores_and_columns(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([rng.random(), 0.5]), int(rng.random() < 0.4)) for i in range(200)]
    s = spark.createDataFrame(data, "id long, x double, response int")
    pos, neg = [x for _, x, y in data if y], [x for _, x, y in data if not y]
    assert E.roc_auc(s, score="x", grid=False).first().auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    ap = sum(sum(p == q for p in pos) * sum(p >= q for p in pos) / sum(x >= q for _, x, _ in data) for q in set(pos)) / len(pos)
    assert E.average_precision(s, score="x", grid=False).first().average_precision == pytest.approx(ap)
    a, b = s.where("id < 120"), s.where("id >= 120")
    got = E.distance(a, b, "x", 1.0).first()
    xs, ys = sorted(x for i, x, _ in data if i < 120), sorted(x for i, x, _ in data if i >= 120)
    grid = sorted({*xs, *ys})
    gap = [abs(sum(x <= v for x in xs) / len(xs) - sum(y <= v for y in ys) / len(ys)) for v in grid]
    assert got.ks == pytest.approx(max(gap)) and got.wasserstein == pytest.approx(sum(g * (w - v) for g, v, w in zip(gap, grid, grid[1:], strict=False)))
    table = drift_table(a, a.withColumn("ROW_ID", F.lit(1)), ["x", "ROW_ID"]).collect()
    assert [(r.column_name, r.drifted, r.p_drifted, r.p_value) for r in table] == [("x", False, False, 1.0)]
    far = drift_table(a, b.withColumn("x", F.col("x") + 0.4), ["x"]).first()
    assert far.drifted and far.p_drifted and 0 <= far.p_value < 0.01
    assert drift_table(a, b, ["id"]).count() == 0


def test_top_counts_with_many_ties(spark):
    s = scored(spark, [(i, 500 if i % 2 else 900, int(i % 3 == 0)) for i in range(40)])
    order = sorted((-(500 if i % 2 else 900), i) for i in range(40))
    got = {r.k: (r.q, r.tp) for r in E.top_counts(s, [1, 5, 20, 21, 33, 40]).collect()}
    for k in (1, 5, 20, 21, 33, 40):
        assert got[k] == (-order[k - 1][0], sum(i % 3 == 0 for _, i in order[:k]))


def test_score_joins_and_null_counts(spark):
    rows, pred = spark.createDataFrame([(2, 1), (1, 0)], "id long, response int"), spark.createDataFrame([(2, 0.5)], "id long, pred double")
    assert [tuple(r) for r in J.with_scores(rows, pred).collect()] == [(1, 0, 0.0), (2, 1, 0.5)]
    with pytest.raises(ValueError, match="right"):
        J.with_scores(rows, pred.union(pred))
    assert J.with_scores(rows, pred.union(pred), check=False).count() == 3
    with pytest.raises(ValueError, match="3 rows, not 2"):
        J.same_count(J.with_scores(rows, pred.union(pred), check=False), rows)
    df = spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0)], "id long, a string, b double")
    assert {r.column_name: r.nulls for r in J.null_counts(df, ["id", "a", "b"]).collect()} == {"id": 0, "a": 1, "b": 1}
    assert J.no_nulls(df, ["id"]) is df
    with pytest.raises(ValueError, match="'b': 1"):
        J.no_nulls(df, ["a", "b"])


def test_sources_policies_and_grids(spark):
    s = scored(spark)
    same = {"a": s, "b": s}
    assert E.best_source(same)[0] == "a"
    with pytest.raises(FileNotFoundError):
        E.best_source({})
    for bad in ((1.5, 5), (0.5, 101), (-0.1, 5)):
        with pytest.raises(ValueError, match="isn't within"):
            E.checked_policy(*bad)
    with pytest.raises(ValueError, match="aren't within"):
        E.predict_actions(s.withColumn("pred", F.lit(1.2)), 0.5)
    with pytest.raises(ValueError, match="no scores"):
        E.batch_predict(s.where("false"), 0.5, 5.0)
    decisions, counts = E.batch_predict(s, 0.9, 50.0)
    assert counts.first()[2:] == (6, 2, 1) and decisions.where("decision = 1").count() == 3
    grid = spark.createDataFrame([(0.2,), (0.4,), (None,)], "threshold double")
    assert E.nearest_row(grid, "threshold", 0.3).first().threshold == 0.2 and E.nearest_row(grid, "threshold", 0.35).first().threshold == 0.4


def test_duplicate_runs_take_linear_time(spark):
    """All rows in one range: four times the rows take less than eight times as long."""
    import time

    took = []
    for n in (20_000, 20_000, 80_000):  # the first also compiles
        df = spark.range(n).select("id", F.floor(F.col("id") / 7).cast("double").alias("t"), (F.col("id") % 50 < 25).cast("int").alias("v")).coalesce(1)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        began = time.time()
        got = ops.duplicate_runs(df, ["v"], "t", "id").agg(F.sum("run_size").alias("s"), F.max("dup_run").alias("r")).first()
        took.append(time.time() - began)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got.s == n * 25 and got.r == n // 25
    assert took[2] < 8 * took[1] + 2


def test_budgets_with_null_scores(spark):
    """Rows without a score come last, and count as any others in budgets that reach them."""
    rows_ = [(k, 1 if k % 2 else 0, 1000 * k if k < 5 else None) for k in range(10)]
    df = spark.createDataFrame(rows_, "id long, response int, q int")
    got = {int(r.inspection_budget_pct): (r.selected_rows, r.score_cutoff, r.tp, r.fn) for r in E.budget_curve(df, [0, 20, 50, 60, 100]).collect()}
    order = sorted(rows_, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    for p, (k, cut, tp, fn) in got.items():
        top = order[:k]
        assert (k, tp, fn) == (p // 10, sum(r[1] for r in top), 5 - sum(r[1] for r in top))
        assert cut == (1.0 if not k else None if top[-1][2] is None else top[-1][2] / 10000)
    assert [r.tp for r in E.top_lift(df, [1000]).collect()] == [5]
    h = {r.id: r.decision for r in E.hybrid(df, 3000, 60.0).collect()}
    assert sum(h.values()) == 6 and h[3] == h[4] == h[5] == 1 and h[6] == 0


def test_exact_quantiles(spark):
    """Equal to sorting all values, whatever the ranges; nulls are left out, NaN is largest, a column without values has no row."""
    rng = random.Random(3)
    a = [rng.choice([None, 0.5, 1.5, rng.gauss(0, 1)]) for _ in range(500)]
    b = [float(rng.randint(0, 3)) for _ in range(500)]
    df = spark.createDataFrame([(x, y, None) for x, y in zip(a, b, strict=True)], "a double, b double, c double").repartition(7)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    got = {(r.column_name, r.share): r.value for r in quantiles(df, ["a", "b", "c"], shares).collect()}
    want = {}
    for name, xs in (("a", sorted(x for x in a if x is not None)), ("b", sorted(b))):
        for s in shares:
            k = (len(xs) - 1) * s
            want[name, s] = xs[math.floor(k)] + (xs[math.ceil(k)] - xs[math.floor(k)]) * (k - math.floor(k))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert math.isnan(quantiles(nan, ["x"], [1.0]).first().value) and quantiles(nan, ["x"], [0.5]).first().value == 2.0
    assert quantiles(nan.where("x = 7"), ["x"], [0.5]).count() == 0
    assert ops.duration_stats(spark.createDataFrame([], "duration double")) == {"mean": 0.0, "std": 1.0, "low": 0.0, "high": 0.0}


def test_drift_of_categories(spark):
    a = [("x", 1, True)] * 6 + [("y", 2, None)] * 3 + [(None, 3, False)]
    b = [("x", 1, True)] * 2 + [("z", 9, None)] * 3
    ref, cur = (spark.createDataFrame(v, "c string, n int, flag boolean") for v in (a, b))
    got = {r.column_name: r for r in drift_report(ref, cur).collect()}
    p, q = {"x": 0.6, "y": 0.3, None: 0.1}, {"x": 0.4, "z": 0.6}
    mean = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    js = sum(d.get(k, 0) * math.log2(d.get(k, 0) / mean[k]) for d in (p, q) for k in d) / 2
    chi = sum((m * d.get(k, 0) - m * e) ** 2 / (m * e) for k in mean for e in [(10 * p.get(k, 0) + 5 * q.get(k, 0)) / 15] for m, d in ((10, p), (5, q)))
    assert got["c"].kind == "category" and got["c"].distance == pytest.approx(math.sqrt(js)) and got["c"].chi_square == pytest.approx(chi) and (got["c"].degrees, got["c"].unseen, got["c"].drifted) == (3, 1, True)
    assert got["n"].kind == "numeric" and got["n"].degrees is None and got["flag"].unseen == 0
    same = {r.column_name: (r.distance, r.drifted) for r in drift_report(ref, ref).collect()}
    assert same == {"c": (0.0, False), "n": (0.0, False), "flag": (0.0, False)}
    none = {r.column_name: (r.distance, r.drifted) for r in drift_report(ref, cur.where("n > 99")).collect()}
    assert none == {"c": (None, False), "n": (None, False), "flag": (None, False)}
    assert drift_report(ref.withColumnRenamed("n", "Row_ID").select("Row_ID"), cur.withColumnRenamed("n", "Row_ID").select("Row_ID")).count() == 0


def test_means_of_many_failures_keep_their_fractions(spark):
    """Sums that are far larger than what the times differ by."""
    n, base = 400, 4.0e9
    df = spark.createDataFrame([(k, 1, base + k / 1024) for k in range(n)], "id long, response int, end_time double")
    got = {r.id: r.since_5 for r in ops.since_failures(df, (5,)).collect()}
    assert all(got[k] == pytest.approx(3 / 1024, abs=1e-6) for k in range(5, n)) and got[4] is None


def test_scores_off_the_grid_are_refused(spark):
    for q in ("10001", "-1"):
        with pytest.raises(Exception, match="whole number"):
            E.roc_auc(spark.sql(f"SELECT 1 AS id, 1 AS response, {q} AS q UNION ALL SELECT 2, 0, 5")).collect()
    assert E.roc_auc(spark.sql("SELECT 1 AS id, 1 AS response, 10000 AS q UNION ALL SELECT 2, 0, 0")).first().auc == 1.0
