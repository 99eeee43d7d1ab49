import random

import numpy as np

from faultline.llm import language as lg


def corpus(n, seed=2):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "wh", "er"], "bb": ["sch", "ung", "ß", "ei"], "cc": ["ción", "que", "ñ", "ar"]}
    for i in range(n):
        lang = rng.choice(sorted(parts))
        yield i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 90))), lang


def test_held_out_accuracy(spark):
    rows = [*corpus(360), (900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "the wher ing " * 9000, None), (0, "the", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = lg.language_id(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows if i < 900 and lang}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, lg.LENGTH)).astype(np.uint8)
    net = lg.train(x, np.array([0, 1, 0, 1, 1]), ["a", "b"], epochs=1)
    pooled = []
    for w in lg.WIDTHS:
        h = np.stack([np.stack([net.embedding[row[k : k + w]].ravel() @ net.filters[w] for k in range(lg.LENGTH - w + 1)]) for row in x])
        pooled.append(h.max(axis=1) + net.bias[w])
    want = lg._log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias)
    assert np.allclose(lg.Predictor(net).log_probabilities(x), want, atol=1e-3)


def test_nothing_to_learn_one_language_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None), (3, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in lg.language_id(docs).collect()} == {("und", 0.0)}
    assert lg.language_id(docs.where("false")).collect() == []
    docs = spark.createDataFrame([(i, "abc", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lg.language_id(docs).collect()} == {"xx"}


def test_chunks_do_not_matter():
    x = np.frombuffer(b"abc " * 48, np.uint8).reshape(1, -1)
    net = lg.train(np.repeat(x, 4, 0), np.array([0, 1, 0, 1]), ["a", "b"], epochs=1)
    own, texts = lg.Predictor(net), ["abc " * k for k in (1, 60, 500, 2)] + [None, "...", "x" * 3000]
    assert [r[0] for r in own.predict(texts, chunk=3)] == [r[0] for r in own.predict(texts)]
    assert np.allclose([r[1] for r in own.predict(texts, chunk=3)], [r[1] for r in own.predict(texts)])


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (4, lg.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1])
    p = {"e": rng.normal(0, 0.5, (256, lg.EMBEDDING)), "v": rng.normal(0, 0.3, (len(lg.WIDTHS) * lg.FILTERS, 3)), "c": rng.normal(0, 0.1, 3)}
    for w in lg.WIDTHS:
        p |= {f"w{w}": rng.normal(0, 0.3, (w * lg.EMBEDDING, lg.FILTERS)), f"b{w}": rng.normal(0, 0.1, lg.FILTERS)}
    _, g = lg.gradients(p, x, y)
    for k, a in p.items():
        places = [np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(g[k]).ravel())[:4]]
        for at in places:
            before, step = a[at], 1e-5
            a[at] = before + step
            up = lg.gradients(p, x, y)[0]
            a[at] = before - step
            down = lg.gradients(p, x, y)[0]
            a[at] = before
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), (k, at)


def test_query_equals_plain_prediction(spark):
    rows = [*corpus(60, seed=8), (700, "é" * 400, "cc"), (701, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    net = lg.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lg.identify(docs, net).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        if not raw:
            assert got[i] == ("und", 0.0)
            continue
        mean, total = np.zeros(len(net.languages)), 0
        for k in range(0, len(raw), lg.LENGTH):
            part = np.frombuffer(raw[k : k + lg.LENGTH].ljust(lg.LENGTH, b"\0"), np.uint8)
            pooled = [max((net.embedding[part[j : j + w]].ravel() @ net.filters[w] + net.bias[w] for j in range(lg.LENGTH - w + 1)), key=lambda h, f=f: h[f])[f] for w in lg.WIDTHS for f in range(lg.FILTERS)]
            z = np.maximum(np.array(pooled), 0) @ net.out + net.out_bias
            n = len(raw[k : k + lg.LENGTH])
            mean, total = mean + n * (z - np.log(np.exp(z).sum())), total + n
        p = np.exp(mean / total) / np.exp(mean / total).sum()
        assert got[i][0] == net.languages[p.argmax()] and abs(got[i][1] - p.max()) < 2e-3
