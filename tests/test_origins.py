"""Rolling origins, their log, regimes and the prevalence-matched control."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import bootstrap as S
from faultline.operators import origins as O
from faultline.operators.boosting import Params


def parts(spark, n=240):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.random() < (0.6 if k % 3 == 0 else 0.1)), float(k % 50), float(rng.normal()), f"L0_S{k % 3}|L1_S{k % 2}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, response int, start_time double, x double, path_signature string")


def test_origins_learn_from_the_past_and_go_on(spark, tmp_path):
    """A broken run keeps its origins; the scores are those of a plain loop."""
    rows = O.time_parts(parts(spark), 4).cache()
    log, calls = f"file://{tmp_path}/log", []
    score = O.path_rates()

    def breaks(before, window):
        calls.append(window.agg(F.min("part")).first()[0])
        if calls == [1, 2]:
            raise RuntimeError("lost")
        return score(before, window)

    with pytest.raises(RuntimeError):
        O.run_origins(rows, breaks, log)
    got = O.run_origins(rows, breaks, log).collect()
    assert calls == [1, 2, 2, 3] and len(got) == 180
    plain = rows.collect()
    order = sorted(plain, key=lambda r: (r.start_time, r.id))
    assert all(r.part == k * 4 // 240 for k, r in enumerate(order))
    for r in got:
        own = next(x for x in plain if x.id == r.id)
        before = [x for x in plain if x.part < own.part]
        g = sum(x.response for x in before) / len(before)
        same = [x.response for x in before if x.path_signature == own.path_signature]
        assert r.fold == own.part and r.q == int(10_000 * (sum(same) + 10 * g) / (len(same) + 10) + 0.5)


def test_boosted_origins(spark, tmp_path):
    rows = O.time_parts(parts(spark), 2)
    got = O.run_origins(rows, O.boosted(["start_time", "x"], Params(rounds=3, rate=0.5, depth=2, leaf=5, patience=3, bins=16)), f"file://{tmp_path}/log")
    assert got.count() == 120 and got.where("response = 1").agg(F.avg("q")).first()[0] > got.where("response = 0").agg(F.avg("q")).first()[0]


@pytest.mark.parametrize(
    ("low", "auc_over", "lift_over", "rule"),
    [
        ([(0.55, 0.66), (1.0, 2.0)], True, True, "B"),
        ([(0.55, 0.66), (3.0, 4.0)], True, False, "C"),
        ([(0.62, 0.64), None], True, None, "C"),
        ([(0.30, 0.40), (1.0, 2.0)], False, True, "C"),
        ([(0.70, 0.80), (1.0, 2.0)], False, True, "mixed"),
    ],
)
def test_regimes(spark, low, auc_over, lift_over, rule):
    rows = [(k, m, (a + b) / 2, a, b) for k in (1, 2) for m, a, b in (("auc", 0.6, 0.65), ("lift", 1.5, 2.5))]
    nan = float("nan")
    rows += [(k, m, *((nan, nan, nan) if x is None else (sum(x) / 2, *x))) for k in (3, 4) for m, x in zip(("auc", "lift"), low, strict=True)]
    got = O.regime(spark.createDataFrame(rows, "fold int, metric string, mean double, low double, high double")).first()
    assert (got.regime, got.auc_over, got.lift_over) == (rule, auc_over, lift_over)


def test_control_equals_plain_draws(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.random() < 0.3), int(rng.integers(0, 40)) * 200 + (1500 if k % 4 == 0 else 0), k % 2) for k in range(300)]
    rows += [(k, 0, 100, 2) for k in range(9)] + [(k, int(k == 0), 100, 3) for k in range(40)] + [(k, k % 2, 5, 4) for k in range(4)]
    df = spark.createDataFrame(rows, "id long, response int, q int, fold int")
    got = {(r.fold, r.metric): r for r in S.resampled(df, "fold", replicates=40, seed=7, prevalence=0.1).collect()}
    assert got[2, None].status == "one_class" and got[3, None].status == "too_few" and (got[3, None].need, got[3, None].available) == (4, 1) and got[4, None].status == "none_left"
    for fold in (0, 1):
        own = sorted({r[2] for r in rows if r[3] == fold}, reverse=True)
        pos, neg = (np.array([sum(r[1] == y and r[2] == q for r in rows if r[3] == fold) for q in own]) for y in (1, 0))
        need = round(neg.sum() * 0.1 / 0.9)
        found = {m: [] for m in S.METRICS}
        for k in range(40):
            g = np.random.default_rng([7, k])
            both = np.concatenate([g.multivariate_hypergeometric(pos, need), neg])
            draw = g.multinomial(both.sum(), both / both.sum())
            y = [c for c, n in zip([1] * len(own) + [0] * len(own), draw) for _ in range(n)]
            s = [q for q, n in zip(own * 2, draw) for _ in range(n)]
            order = sorted(range(len(y)), key=lambda i: -s[i])
            p, n = sum(y), len(y)
            found["auc"].append(sum((s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in order if y[i] for j in order if not y[j]) / (p * (n - p)))
            ap = sum(sum(1 for i in order if y[i] and s[i] == v) * sum(1 for i in order if y[i] and s[i] >= v) / sum(1 for i in order if s[i] >= v) for v in set(s)) / p
            found["average_precision"].append(ap)
            found["lift"].append(ap / (p / n))
            found["brier"].append(np.mean([(y[i] - s[i] / 10_000) ** 2 for i in order]))
            found["cost_per_100k_rows"].append(sum(100 if y[i] and s[i] < 6000 else 5 if not y[i] and s[i] >= 6000 else 0 for i in order) / n * 1e5)
            top, left, hits = -(-n * 10 // 1000), -(-n * 10 // 1000), 0.0
            for v in sorted(set(s), reverse=True):
                tied = [y[i] for i in order if s[i] == v]
                take = min(left, len(tied))
                hits, left = hits + sum(tied) * take / len(tied), left - take
            found["top_precision"].append(hits / top)
            found["top_recall"].append(hits / p)
        for m, xs in found.items():
            r = got[fold, m]
            assert (r.valid, r.need, r.status) == (40, need, "feasible")
            assert (r.mean, r.low, r.high) == pytest.approx((np.mean(xs), np.percentile(xs, 2.5), np.percentile(xs, 97.5)))


def test_many_groups_are_dealt_in_ranges(spark):
    """Without the driver: whole groups, and as even as the text says."""
    from faultline.operators.folds import group_folds, leaks

    rows = spark.range(300_000).select((F.col("id") % 120_000).alias("g"), (F.xxhash64("id") % 7 == 0).cast("int").alias("y"))
    got = group_folds(rows, "g", "y", 5, one_by_one=1000)
    assert leaks(got, "g", "cv_fold").where("leaks").count() == 0
    by = got.groupBy("cv_fold").agg(F.sum("y").alias("pos"), F.count("*").alias("n"), F.countDistinct("g").alias("g")).collect()
    assert len(by) == 5 and sum(r.n for r in by) == 300_000 and {r.g for r in by} == {24_000}
    assert max(r.pos for r in by) - min(r.pos for r in by) <= 3 and max(r.n for r in by) - min(r.n for r in by) <= 3 * 4
    few = spark.createDataFrame([(None, 1), (None, 0), ("a", 0), ("b", 1)], "g string, y int")
    for bound in (0, 100):
        assert sorted(r.n for r in group_folds(few, "g", "y", 3, one_by_one=bound).groupBy("cv_fold").agg(F.count("*").alias("n")).collect()) == [1, 1, 2]


def test_walk_of_reports(spark):
    from faultline.operators import reports as R

    texts = [(1, '{"a": [1, {"name": "x", "value": "2.5", "threshold": 2, "more": [[{"value": 7}]]}], "b": {"c": null, "d": true}, "e": {}}'), (2, "not json"), (3, None), (4, '"leaf"'), (5, "[]")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = sorted((r.id, r.path, r.name, r.value) for r in R.walk(df, "text", "id").collect())
    assert got == [(1, "$.a[0]", None, "1"), (1, "$.a[1].more[0][0].value", "value", "7"), (1, "$.a[1].name", "name", "x"), (1, "$.a[1].threshold", "threshold", "2"), (1, "$.a[1].value", "value", "2.5"), (1, "$.b.c", "c", None), (1, "$.b.d", "d", "true"), (4, "$", None, "leaf")]
    told = sorted((r.path, r.name, r.value, r.threshold, r.exceeded) for r in R.measures(R.walk(df, "text", "id"), "id").collect())
    assert told == [("$.a[1]", "x", 2.5, 2.0, True), ("$.a[1].more[0][0]", None, 7.0, None, None)]


def test_scratch_is_deleted(spark):
    from faultline.operators.ordered import running
    from faultline.sources.scratch import materialize, scratch

    kept = materialize(spark.range(3))
    with scratch(spark):
        df = running(spark.range(10), [F.col("id")])
        folders = {f.rsplit("/", 1)[0].removeprefix("file:") for f in df.inputFiles()}
        assert df.count() == 10 and folders
    import os

    assert not any(os.path.exists(f) for f in folders) and kept.count() == 3


def test_micro_batches_of_the_label_replay_dont_grow_with_the_table(spark, tmp_path, monkeypatch):
    from faultline.plans import origins

    few, rows = sorted(map(tuple, origins.label_replay_windows(spark, "/root/testdata/sf0.01").collect())), 15_000
    monkeypatch.setattr(origins, "shared_dir", lambda _: f"file://{tmp_path}/replay")
    monkeypatch.setattr(origins, "SLICE_ROWS", rows // 12)
    assert sorted(map(tuple, origins.label_replay_windows(spark, "/root/testdata/sf0.01").collect())) == few
    files = spark.read.parquet(f"file://{tmp_path}/replay/in").groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert files[0] <= 2 * rows // 12 and files[1] == 2 * rows + 2
