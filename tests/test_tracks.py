"""Sources, sinks, streams, models and golden numbers."""

import json
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from faultline.functions import exprs as X
from faultline.operators.bootstrap import bootstrap_interval, bootstrap_replicates
from faultline.operators.boosting import Params
from faultline.operators.models import ensemble, oof_predictions, two_stage
from faultline.sources import ingest as I
from faultline.streaming.scorer import State, next_state, score_stream, windowed_counts


def test_states_wrap_around_and_start_over():
    s = State(dataset_rows=25)
    seen = []
    for _ in range(4):
        s = next_state(s, 10, 25)
        seen.append((s.pointer, s.cycle_id, s.batch_id, s.run_seq))
    assert seen == [(10, 0, 1, 1), (20, 0, 2, 2), (0, 1, 0, 3), (10, 1, 1, 4)]
    assert next_state(s, 10, 30) == State(10, 0, 1, 5, 30)
    assert next_state(State(99, 0, 3, 3, 25), 10, 25) == State(10, 0, 4, 4, 25)


def test_stream_is_append_only_and_refuses_labels(spark, tmp_path):
    base = f"file://{tmp_path}"
    batch = lambda k: spark.createDataFrame([(k * 10 + i, i * 1000, i / 10) for i in range(10)], "id long, q int, pred double").coalesce(1)
    for k in range(2):
        batch(k).write.mode("append").parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c", threshold=9000, percent=20.0)
    first = {r.id for r in I.read_partitions(spark, f"{base}/out").collect()}
    batch(2).write.mode("append").parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c", threshold=9000, percent=20.0)
    got = I.read_partitions(spark, f"{base}/out")
    assert len(first) == 20 and got.count() == 30 and got.where("auto_reject = 1").count() == 3 and got.where("decision = 1").count() == 6
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1, 2}
    assert not I.write_partition(batch(0), f"{base}/out", {"cycle": 0, "batch": 0})
    with pytest.raises(ValueError, match="may not read"):
        score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/d", schema="id long, q int, Response int")


def test_windows_of_tables(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted((r.n, r.value) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_archives_and_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "Id,a,Response\n1,2.5,1\n2,zz,\n3,4,0\n")
    assert [p.name for p in I.unzip(tmp_path / "a.zip", tmp_path / "out")] == ["x.csv"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out-side/x.csv", "x")
    with pytest.raises(ValueError, match="leaves"):
        I.unzip(tmp_path / "b.zip", tmp_path / "out")
    df = I.coerced(I.read_csv_tree(spark, f"file://{tmp_path}/out", I.all_strings(["Id", "a", "Response"])), {"a": "float", "Response": "int"}, label="Response")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2.5, 1), (2, None, 0), (3, 4.0, 0)]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        I.read_csv_tree(spark, f"file://{tmp_path}/none", "a string")
    csv, pq = f"file://{tmp_path}/out/d/x.csv", f"file://{tmp_path}/x.parquet"
    assert I.csv_to_parquet(spark, csv, pq, "Id long, a string, Response int", first=2, order="Id") == (2, "generated")
    assert I.csv_to_parquet(spark, csv, pq, "Id long, a string, Response int") == (2, "skipped")
    I.write_submission(df, f"file://{tmp_path}/sub")
    assert [r.Id for r in spark.read.csv(f"file://{tmp_path}/sub", header=True, inferSchema=True).orderBy("Id").collect()] == [1, 2, 3]


def test_summary_and_lookup(spark, tmp_path):
    I.upsert_summary(tmp_path / "s.json", "a", {"x": 1})
    I.upsert_summary(tmp_path / "s.json", "b", {"x": 2})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": {"x": 1}, "b": {"x": 2}}
    from faultline.operators.features import path_lookup

    rows = spark.createDataFrame([(1, "a|b", 1), (2, "a", 0)], "id long, path_signature string, response int")
    mark = I.fingerprint(rows, ["f", "e"])
    assert mark == I.fingerprint(rows.orderBy(F.desc("id")), ["e", "f"]) and len(mark) == 16 and mark != I.fingerprint(rows.where("id = 1"), ["e", "f"])
    path = f"file://{tmp_path}/lookup"
    I.save_lookup(path_lookup(rows), path, 0.5, mark)
    lookup, overall = I.load_lookup(spark, path, mark)
    assert overall == 0.5 and {r.token: r.rate for r in lookup["station"].collect()} == {"a": 0.5, "b": 1.0}
    with pytest.raises(ValueError, match="other data"):
        I.load_lookup(spark, path, "0" * 16)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, (i * 37) % 10000, int(i % 7 == 0 or i > 900)) for i in range(1000)], "id long, q int, response int")
    a = bootstrap_interval(df, 60).orderBy("metric").collect()
    assert a == bootstrap_interval(df, 60).orderBy("metric").collect()
    assert all(r.low < r.high and r.valid == 60 for r in a)
    assert bootstrap_replicates(df, 20, positives=30).count() == 20
    one = bootstrap_interval(df.where("response = 0"), 20).collect()
    assert one == []


def test_models(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0), float(i % 3 == 0) + (i % 5) / 50, i % 2) for i in range(120)], "id long, response int, x double, cv_fold int")
    pred, importance = oof_predictions(df, ["x"], folds=2, params=Params(rounds=4, rate=0.5, depth=2, leaf=5, bins=16))
    got = pred.collect()
    assert len(got) == 120 and len({r.id for r in got}) == 120 and importance.first().feature == "x"
    assert min(r.oof_pred for r in got if r.response) > max(r.oof_pred for r in got if not r.response)
    e = ensemble(spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double"), [["a", "b"], ["c"]]).first()
    assert e.pred == 3.75
    t = two_stage(spark.createDataFrame([(1, 1, 0.2, 0.9), (2, 3, 0.2, 0.9), (3, 3, 0.2, None)], "id int, run_size int, a double, b double"), "a", "b")
    assert sorted((r.id, r.pred) for r in t.collect()) == [(1, 0.2), (2, 0.9), (3, 0.2)]


#: Golden numbers: MCC of five rolling origins have mean 0.1194, deviation 0.0540 and this interval.
def test_golden_interval_from_mean_and_deviation():
    mean, std, n, t = 0.1194, 0.0540, 5, 2.776
    half = t * std / n**0.5
    assert abs(mean - half - 0.0523) < 2e-4 and abs(mean + half - 0.1865) < 2e-4


def test_costs(spark):
    got = spark.createDataFrame([(3, 2)], "fp int, fn int").select(X.cost(F.col("fp"), F.col("fn")).alias("c")).first()
    assert got.c == 215.0


def test_reports(spark, tmp_path):
    from faultline.operators import reports as R

    arms = spark.createDataFrame([("h", 0.15337, 0.11679), ("b", 0.16141, 0.11849808449878249), ("c", 0.15977, 0.11953553351063086)], "arm string, incv double, oot double")
    got = {r.arm: r for r in R.durability(arms, "h").collect()}
    assert got["h"].durability_pct is None and round(got["h"].retained_pct, 1) == 76.1 or round(got["h"].retained_pct, 1) == 76.2
    assert (round(got["b"].durability_pct, 1), round(got["b"].retained_pct, 1), round(got["c"].durability_pct, 1)) == (21.2, 73.4, 42.9)
    a = R.attribution(0.15337, 0.11679, 0.104268)
    assert [round(x, 6) for x in a.values()] == [-0.03658, -0.012522, -0.049102]
    assert R.load_policy(tmp_path / "none.json") == R.Policy(0.6, 5.0)
    (tmp_path / "p.json").write_text(json.dumps({"final_recommendation": {"threshold_high": 0.7}}))
    assert R.load_policy(tmp_path / "p.json") == R.Policy(0.7, 5.0)
    good = {"model_name": "m", "feature_cols": ["a"], "threshold": 0.5, "oof_mcc": 0.1, "training_rows": 3, "folds": [{"fold": 0, "rows": 3, "threshold": 0.5, "mcc": 0.1}]}
    assert R.model_problems(good) == [] and R.model_problems(good | {"threshold": 2, "feature_cols": ["a", "a"]}) == ["feature_cols", "threshold"]
    assert "folds" in R.model_problems({k: v for k, v in good.items() if k != "folds"})


#: Golden numbers: counts of operating points with their MCC, precision, recall and cost.
@pytest.mark.parametrize(("tp", "fp", "fn", "tn", "precision", "recall", "mcc", "cost"), [
    (3099, 19019, 3780, 1157849, 0.1401121258703318, 0.4505015263846489, 0.2438094554828599, 473095.0),
    (2462, 9376, 4417, 1167492, 0.2079743199864842, 0.3579008576828027, 0.2673169497456962, 488580.0),
])
def test_golden_operating_points(spark, tp, fp, fn, tn, precision, recall, mcc, cost):
    from faultline.operators.evaluate import cost_table, with_metrics

    r = cost_table(with_metrics(spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long"))).first()
    assert (r.precision, r.recall, r.mcc, r.total_cost) == (pytest.approx(precision), pytest.approx(recall), pytest.approx(mcc), cost)
    assert r.cost_per_100k_rows == pytest.approx(cost / (tp + fp + fn + tn) * 1e5)


def test_feature_pipeline(spark, tmp_path):
    from faultline.operators.feature_pipeline import FeaturePipeline

    rows = [(i, int(i % 4 == 0), float(i), float(i + 2), 2.0, i / 10, "a|b" if i % 2 else "a") for i in range(1, 41)]
    parts = spark.createDataFrame(rows, "id long, response int, start_time double, end_time double, duration double, feature_mean double, path_signature string")
    fitted = FeaturePipeline.fit(parts)
    fitted.save(f"file://{tmp_path}/p")
    loaded = FeaturePipeline.load(spark, f"file://{tmp_path}/p")
    assert (loaded.mark, loaded.overall, loaded.medians) == (fitted.mark, 0.25, fitted.medians)
    new = parts.where("id > 30").drop("response")
    a = fitted.transform(new, parts).orderBy("id").collect()
    assert a == loaded.transform(new, parts).orderBy("id").collect() and len(a) == 10 and "response" not in a[0].asDict()
    assert next(r for r in a if r.id == 33).since_1 == 1.0  # the failure of part 32
    none = fitted.transform(new).collect()
    assert {r.since_1 for r in none} == {fitted.medians["since_1"]}
    with pytest.raises(ValueError, match="look back"):
        fitted.transform(new, parts.where("response = 0"), need_history=True)
    with pytest.raises(ValueError, match="look ahead"):
        fitted.transform(new.withColumn("till_next_1", F.lit(1)))


def test_feature_pipeline_blocks(spark, tmp_path):
    from faultline.operators.feature_pipeline import DATASET_G, DATASET_H, FeaturePipeline, dataset_e1

    rows = [(i, int(i % 4 == 0), float(i), float(i + 2), 2.0 + i % 5, i // 2 / 10, "a|b" if i % 2 else "a", None if i % 7 == 0 else float(i), "xyz"[i % 3]) for i in range(1, 41)]
    parts = spark.createDataFrame(rows, "id long, response int, start_time double, end_time double, duration double, feature_mean double, path_signature string, s1 double, kind string")
    fitted = FeaturePipeline.fit(parts.where("id <= 30"), numeric=["s1"], categorical=["kind"], same=["feature_mean"])
    fitted.save(f"file://{tmp_path}/p")
    new = parts.where("id > 30").withColumn("kind", F.when(F.col("id") == 31, "new").otherwise(F.col("kind")))
    got = fitted.transform(new, parts).orderBy("id").collect()
    assert got == FeaturePipeline.load(spark, f"file://{tmp_path}/p").transform(new.withColumn("response", F.lit(1)), parts).orderBy("id").collect()
    by = {r.id: r for r in got}
    assert list(got[0].asDict()) == [c for c, _, _ in fitted.contract] and by[35].s1 == fitted.medians["s1"] and by[36].s1 == 36.0
    rate = [y for _, y, *_, k in rows[:30] if k == "z"]
    assert by[31].kind_target_enc == fitted.overall and by[32].kind_target_enc == pytest.approx(sum(rate) / len(rate))
    assert (by[32].run_size, by[32].run_rank, by[32].run_rank_desc, by[31].run_size) == (2, 1, 2, 1)
    assert (by[33].last_25, by[33].week_part, by[33].shift) == (3, 33, 1) and by[33].in_week == 33.0 and not any(c.startswith("next") for c in by[33].asDict())
    assert (len(DATASET_G), len(DATASET_H), len(dataset_e1(["L0_S0"] * 50))) == (12, 16, 68)


def test_manifests_carry_only_doubts_on(spark, tmp_path):
    p = tmp_path / "manifest.json"
    assert I.sample_evidence(p) == {}
    p.write_text("no json")
    assert I.sample_evidence(p) == {}
    p.write_text(json.dumps({"is_full_data": False, "row_counts": {"a": 5, "b": "x"}}))
    assert I.sample_evidence(p) == {"a": 5}
    held = I.write_manifest(spark, p, {"a": (5, "skipped"), "b": (9, "generated")})
    assert held["status"] == "mixed" and held["is_full_data"] is None and held["files"]["a"]["full_data_status"] == "sampled"
    assert I.sample_evidence(p) == {"a": 5}
    assert I.write_manifest(spark, p, {"a": (6, "skipped")})["status"] == "unknown"
    assert I.write_manifest(spark, p, {"a": (6, "generated")}, sample_rows=6, tag="t")["is_full_data"] is False
    assert I.write_manifest(spark, p, {"a": (7, "generated")})["is_full_data"] is True and I.sample_evidence(p) == {}


def test_appends_keep_to_the_schema(spark, tmp_path):
    base = f"file://{tmp_path}"
    I.append_locked(spark.createDataFrame([(1, 2.5)], "id long, x float"), f"{base}/t")
    I.append_locked(spark.createDataFrame([("3.5", 2)], "x string, id int"), f"{base}/t")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/t").collect()) == [(1, 2.5), (2, 3.5)]
    with pytest.raises(ValueError, match="aren't those"):
        I.append_locked(spark.createDataFrame([(1,)], "id long"), f"{base}/t")
    with pytest.raises(ValueError, match="don't fit"):
        I.append_locked(spark.createDataFrame([(1, "x")], "id long, x string"), f"{base}/t")
    for k in range(2):
        I.append_log(spark.createDataFrame([(k, "a,b")], "n long, s string"), f"{base}/log")
    assert sorted(tuple(r) for r in spark.read.csv(f"{base}/log", schema="n long, s string", header=True).collect()) == [(0, "a,b"), (1, "a,b")]
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert I.load_all(spark, {"a": f"{base}/a.csv"}, "x int")["a"].count() == 1
    with pytest.raises(FileNotFoundError, match="b"):
        I.load_all(spark, {"a": f"{base}/a.csv", "b": f"{base}/b.csv"}, "x int")
    with pytest.raises(ValueError, match="order"):
        I.csv_to_parquet(spark, f"{base}/a.csv", f"{base}/p", "x int", first=1)


def test_uncommitted_partitions_are_not_read(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    df = lambda k: spark.createDataFrame([(k, 10 - k)], "id long, run_seq long")
    for k in range(3):
        I.write_partition(df(k), base, {"cycle": 0, "batch": k})
    (tmp_path / "out/cycle=0/batch=1/_SUCCESS").unlink()
    assert [r.id for r in I.read_partitions(spark, base).collect()] == [2, 0]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        I.read_partitions(spark, f"file://{tmp_path}/none")


def test_stored_states(tmp_path):
    from faultline.streaming.scorer import load_state, save_state

    p = tmp_path / "s.json"
    assert load_state(p) == State()
    save_state(State(5, 1, 2, 3, 25), p)
    assert load_state(p) == State(5, 1, 2, 3, 25)
    for bad in ("{", "[]", '{"pointer": 5}', '{"pointer": "x", "cycle_id": 0, "batch_id": 0, "run_seq": 0, "dataset_rows": 1}'):
        p.write_text(bad)
        assert load_state(p) == State()


def test_sliding_windows_start_over(spark):
    from faultline.streaming.scorer import replay_window

    placed = spark.createDataFrame([(i, i * 1000, int(i > 6), i) for i in range(10)], "id long, q int, response int, pos long")
    row, pointer = replay_window(placed, 8, 4, threshold=9000, percent=50.0)
    assert pointer == 0 and row.first()[:4] == (8, 10, 2, True) and row.first().tp == 1
    row, pointer = replay_window(placed, 99, 4, threshold=9000, percent=50.0)
    assert pointer == 4 and (row.first().start, row.first().flagged_pct) == (0, 50.0)


def test_wide_tables(spark):
    from faultline.operators import wide as W

    df = spark.createDataFrame([(1, 2.0, None, 4.0, "x", 7.0, 3.0), (2, None, None, None, "y", None, None)], "id long, L0_S2_F1 double, L0_S2_F3 double, L0_S10_F1 double, L1_S0_F0 string, L0_S2_D5 double, L0_S10_D1 double")
    assert W.sensor_columns(df) == ["L0_S2_F1", "L0_S2_F3", "L0_S10_F1"] and W.date_columns(df) == ["L0_S2_D5", "L0_S10_D1"]
    assert W.stations(W.sensor_columns(df)) == ["L0_S2", "L0_S10"] and W.stations(W.sensor_columns(df), numeric=False) == ["L0_S10", "L0_S2"]
    assert sorted(tuple(r) for r in W.wide_station_means(df, prefix="m_").collect()) == [(1, 2.0, 4.0), (2, None, None)]
    assert sorted(tuple(r) for r in W.wide_times(df).collect()) == [(1, 3.0, 7.0), (2, None, None)]
    assert sorted(tuple(r) for r in W.to_readings(df).collect()) == [(1, "L0", "L0_S10", "L0_S10_F1", 4.0), (1, "L0", "L0_S2", "L0_S2_F1", 2.0)]
    assert W.to_readings(df.select("id")).count() == 0 and W.wide_times(df.select("id")).first().start_time is None
    assert W.without_suffix(["a_target_enc", "b"]) == ["a", "b"] and W.with_prefix(["x"]) == ["sensor_mean_x"]


def test_put_only_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.txt"
    I.put_new(spark, path, b"one")
    with pytest.raises(FileExistsError):
        I.put_new(spark, path, b"two")
    assert (tmp_path / "a/b.txt").read_bytes() == b"one"
    with pytest.raises(FileExistsError):
        I.upload_new(spark, str(tmp_path / "a/b.txt"), path)
    I.upload_new(spark, str(tmp_path / "a/b.txt"), path + "2")
    assert (tmp_path / "a/b.txt2").read_bytes() == b"one"


def test_racing_writers(spark, tmp_path):
    """Of several writers of one partition one wins; its rows are there once, the others' not at all, and nothing staged is left."""
    base = f"file://{tmp_path}/out"
    df = lambda k: spark.range(100).select("id", F.lit(k).alias("writer"))
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: I.write_partition(df(k), base, {"cycle": 0, "batch": 1}), range(4)))
    assert sum(won) == 1
    got = I.read_partitions(spark, base, order="id").collect()
    assert sorted(r.id for r in got) == list(range(100)) and {r.writer for r in got} == {won.index(True)}
    assert not list((tmp_path / "out").glob(".staged-*"))
    with pytest.raises(FileExistsError):
        I.write_partition(df(9), base, {"cycle": 0, "batch": 1}, must_be_new=True)


def test_claim_of_a_lost_writer_is_carried_out(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    spark.range(5).write.parquet(f"{base}/.staged-lost")
    I.put_new(spark, f"{base}/.claims/cycle=0,batch=3", f"{base}/.staged-lost".encode())
    assert not I.write_partition(spark.range(7), base, {"cycle": 0, "batch": 3})
    assert I.read_partitions(spark, base).count() == 5
    (tmp_path / "out/cycle=0/batch=4").mkdir(parents=True)  # an unmarked folder of an older form
    (tmp_path / "out/cycle=0/batch=4/part-0.parquet").write_bytes(b"junk")
    assert I.write_partition(spark.range(2), base, {"cycle": 0, "batch": 4}) and I.read_partitions(spark, base).count() == 7


def test_replay_windows_are_those_of_a_pointer_in_few_jobs(spark):
    from faultline.streaming.scorer import replay_window, replay_windows

    rows = [(k, k, None if k % 11 == 5 else 97 * k % 10_000, k * 31 % 5 // 4) for k in range(205)]
    placed = spark.createDataFrame(rows, "id long, pos long, q int, response int").cache()
    want, pointer = [], 30
    while pointer:
        row, pointer = replay_window(placed, pointer, 25, threshold=9000, percent=12.0)
        want += row.collect()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("replay_windows", "")
    got = replay_windows(placed, 30, 25, threshold=9000, percent=12.0).orderBy("start").collect()
    jobs = len(tracker.getJobIdsForGroup("replay_windows"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[-1].reset and jobs < len(want)
    assert replay_windows(placed.where("false"), 0, 25, threshold=9000, percent=12.0).count() == 0


def test_pivots_deal_their_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from faultline.operators import features as ops
    from faultline.operators import wide as W
    from faultline.plans import records

    monkeypatch.setattr(W, "PIVOT_ROWS", 5_000)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for got in (records.wide(spark, "/root/testdata/sf0.01").select("id", "L0_S0_F3"), ops.station_means(records.V.readings(spark, "/root/testdata/sf0.01"), ["L0_S0", "L1_S5"])):
            tasks = got.groupBy(F.spark_partition_id()).count().collect()
            assert len(tasks) == 12 and max(r["count"] for r in tasks) < 2_000 and got.select("id").distinct().count() == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("timed", [True, False])
def test_feature_pipeline_sorts_rows_once(spark, monkeypatch, timed):
    """Times, runs, old windows and history are those of the operators, with missing times as well; all rows are put in order once only."""
    from faultline.operators import features, ordered
    from faultline.operators.feature_pipeline import FeaturePipeline

    at = lambda i: None if i % 9 == 0 or not timed else i * 7 % 12 / 4
    rows = [(i, int(i % 4 == 0), at(i), None if at(i) is None else at(i) + i % 3, 2.0 + i % 5, i // 2 % 3 / 10, "a|b" if i % 2 else "a") for i in range(1, 1801)]
    parts = spark.createDataFrame(rows, "id long, response int, start_time double, end_time double, duration double, feature_mean double, path_signature string")
    fitted = FeaturePipeline.fit(parts)
    past = features.since_failures(parts.select("id", "response", "end_time"))
    assert {k: fitted.medians[k] for k in ("since_1", "since_10")} == features.medians(past, ["since_1", "since_10"])
    placed = []
    real = ordered.sorted_rows

    def counted(*a, **b):
        got = real(*a, **b)
        placed.append(got.count())
        return got

    with monkeypatch.context() as m:
        m.setattr(ordered, "sorted_rows", counted)
        m.setattr(features, "sorted_rows", counted)
        got = {r.id: r.asDict() for r in fitted.transform(parts, parts).collect()}
    if timed:
        assert len(got) == len(rows) and len(rows) <= sum(placed) < 2 * len(rows)
    context = parts.where("response = 1")
    both = parts.select("id", "end_time", F.lit(0).alias("response")).unionByName(context.select((-F.col("id")).alias("id"), "end_time", "response"))
    want = (
        (features.core_features(parts), ("start_time", "records_last_1hr", "records_last_24hr", "density_ratio")),
        (features.duplicate_runs(parts, ["path_signature", "feature_mean"], "start_time", "id"), ("run_size", "run_rank", "run_rank_desc")),
        (features.legacy_features(parts.select("id")), ("last_25", "last_1680", "week_part", "shift")),
        (features.since_failures(both).where("id > 0"), ("since_1", "since_10")),
    )
    for table, names in want:
        for r in table.select("id", *names).collect():
            fill = {n: fitted.medians.get(n, 0) for n in names}
            assert {n: got[r.id][n] for n in names} == {n: fill[n] if r[n] is None else r[n] for n in names}
