import random

import numpy as np

from faultline.llm import quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    good = ["river", "stone", "walked", "morning", "quiet", "the", "of", "and", "through", "letter", "garden"]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = [rng.choice(good) if y else rng.choice("xqzkvw") * rng.randint(1, 5) + "!!" for _ in range(rng.randint(5, 400))]
        docs.append((i, " ".join(words), 9))
        labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_shape(spark):
    docs, labels = corpus(500)
    d = spark.createDataFrame([*docs, (900, None, 1), (901, "", 1), (902, "river stone " * 20000, 1), (0, docs[0][1], 9)], "doc_id long, text string, score int")
    got = quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 100 < len(held) < 250 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert next(r for r in got if r.doc_id == 902).predicted == 1
    calibrated = np.mean([r.score for r in held]) - np.mean([truth[r.doc_id] for r in held])
    assert abs(calibrated) < 0.05


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    from pyspark.sql import functions as F

    held = {r.doc_id for r in d.where(quality.held_out(F.col("doc_id"))).collect()}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (quality.classify(d, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_no_labels_one_class_few_rows_empty(spark):
    docs, _ = corpus(6)
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (2, 1), (3, None), (None, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.classify(d, one).collect())
    two = spark.createDataFrame([(0, 1), (2, 0), (3, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    assert len(quality.classify(d, two).collect()) == 6
    assert quality.classify(d.where("false"), two).collect() == []


def test_keep_good(spark):
    docs, labels = corpus(300, seed=4)
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    kept = quality.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == ["doc_id", "text", "score"]
    good = {i for i, y in labels if y}
    got = {r.doc_id for r in kept.collect()}
    assert len(good & got) > 0.97 * len(good) and len(got - good) < 0.05 * len(good)


def test_rising_curve_has_the_least_squares():
    rng = np.random.default_rng(1)
    x = np.sort(rng.normal(size=60))
    y = (x + rng.normal(size=60) > 0).astype(float)
    weight = rng.uniform(0.5, 2, 60)
    at, values = quality.rising(x, y, weight)
    assert (np.diff(at) > 0).all() and (np.diff(values) >= 0).all()
    # The best rising curve by min-max: of all stretches that end at or after k, the largest mean of those that begin at or before it.
    mean = lambda i, j: (weight[i : j + 1] * y[i : j + 1]).sum() / weight[i : j + 1].sum()
    best = np.array([max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)])
    starts = np.flatnonzero(np.concatenate([[True], np.abs(np.diff(best)) > 1e-12]))
    sums = [(weight[a:b].sum(), (weight[a:b] * y[a:b]).sum(), (weight[a:b] * x[a:b]).sum()) for a, b in zip(starts, [*starts[1:], 60])]
    assert np.allclose(at, [s[2] / s[0] for s in sums]) and np.allclose(values, np.maximum.accumulate([(s[1] + 0.5) / (s[0] + 1) for s in sums]))


def test_query_equals_plain_compression(spark):
    """Dictionaries and curve as fitted; sizes, difference and score by the plain definition for every row."""
    import bisect

    import zstandard
    from pyspark.sql import functions as F

    docs, labels = corpus(200, seed=6)
    docs += [(900, None, 1), (901, "é日" * 3000, 1), (0, docs[0][1], 9)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, lab.where(~quality.held_out(F.col("doc_id"))))

    def plain(text):
        raw = (text or "").encode()
        if not raw:
            return model.prior
        size = [sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(c), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK)) for c in (model.good, model.bad)]
        x, k = (size[1] - size[0]) / len(raw), bisect.bisect([*model.at], (size[1] - size[0]) / len(raw))
        if k in (0, len(model.at)):
            p = model.scores[max(0, k - 1)]
        else:
            (a, b), (u, v) = model.at[k - 1 : k + 1], model.scores[k - 1 : k + 1]
            p = u + (v - u) * (x - a) / (b - a)
        return (p * len(raw) + model.prior * quality.PULL) / (len(raw) + quality.PULL)

    got = sorted((r.doc_id, r.score) for r in quality.classify(d, lab).collect())
    want = sorted((i, plain(t)) for i, t, _ in docs)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
