import hashlib
import random
import re

import pytest

from faultline.llm import decontaminate as dc


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    windows = {}
    for i, text in items:
        w = brute_words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, text in docs:
        w, hit, found = brute_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (o := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= o
        names = ",".join(sorted(map(str, found)))
        yield i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def make(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "b", "The", "é", "c3", "dd", "Èx", "_", "--"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14)))) for k in range(12)] + [(12, None), (13, "..."), (13, "a b c3"), (7, "dd dd")]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "a-b-c3 " * 900), (n + 2, "a-b-c3 " * 900)]
    return docs, items


@pytest.mark.parametrize(("width", "shard_words", "query_words"), [(3, 50, 10**6), (10, 10**6, 10**6), (4, 200, 15)])
def test_equals_brute_force(spark, width, shard_words, query_words):
    docs, items = make(width, 80)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(d, b, width=width, shard_words=shard_words, query_words=query_words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items, width))


def test_empty_tables_and_filter(spark):
    d = spark.createDataFrame([(1, "a b c d", 1), (2, None, 2), (3, "x", 3)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    assert dc.contamination(d.where("false"), b).collect() == []
    assert not any(r.contaminated for r in dc.contamination(d, b.where("false")).collect())
    assert sorted(tuple(r) for r in dc.drop_contaminated(d, b).collect()) == [(2, None, 2), (3, "x", 3)]


def test_proximity(spark, tmp_path):
    docs = [(1, "apple one two three pear"), (2, "pear"), (3, "apple"), (4, "pear apple"), (5, "apple " + "x " * 30 + "pear")]
    path = f"file://{tmp_path}/index"
    dc.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).write.parquet(path)
    index = dc.load_index(spark, path)
    assert {r.doc_id for r in dc.find_near(index, ["Pear apple"], 4).collect()} == {1, 4}
    assert {r.doc_id for r in dc.find_near(index, ["pear apple"], 1).collect()} == {4}
    assert dc.find_near(index, ["pear unknown"], 5).collect() == []
