import random
import re

import numpy as np
import pytest

from faultline.llm import ngram_join as nj
from faultline.llm.components import components


def brute(rows):
    """doc -> (set size, smallest id reachable), by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    line = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        w = list(rng.choice(base)) if kind < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w[at:at] = line
        rows.append((i * 3 + 1, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(2, None), (5, ""), (8, " \n"), (11, "A b C d"), (14, "a B c d"), (17, "a b c"), (20, "x " * 500), (23, "X " * 900), (26, "a b c d e f"), (26, "a b c d e f")]
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"heavy": 2, "block": 200}), (3, {"heavy": 6, "flags": 320})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, id int").repartition(3)
    got = sorted(tuple(r) for r in nj.near_duplicates(docs, **options).collect())
    assert got == brute(rows)


def test_hot_groups_and_small_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(nj, "SENT", 4000)
    rng = random.Random(9)
    texts = [[f"{g}v{k}" for k in range(60)] for g in "ab"]
    rows = []
    for i in range(120):
        w = list(texts[i % 2])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.near_duplicates(docs, heavy=5).collect()) == brute(rows)


def test_empty_table_nulls_and_filter(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (7, "A b c d e f"), (9, None), (None, None)], "doc_id long, text string")
    assert nj.near_duplicates(docs.where("false")).collect() == []
    got = sorted((tuple(r) for r in nj.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (7, 2, 4), (9, 0, 9), (None, 0, None)], key=str)
    kept = nj.drop_near_duplicates(docs.where("doc_id is not null"))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 9]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(200, 200)] + [(300 + k, 300 + (k + 1) % 7) for k in range(7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 150)} | {k: 300 for k in range(301, 307)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_links(rows):
    """(doc, set size, number of other rows with a similar set), by comparing all pairs."""
    sets = [nj.shingles(t) for _, t in rows]
    links = [0] * len(rows)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            links[i] += i != j and len(s) > 0 and len(t) > 0 and nj.similar(len(np.intersect1d(s, t)), len(s), len(t))
    return sorted((d, len(s), n) for (d, _), s, n in zip(rows, sets, links, strict=True))


@pytest.mark.parametrize(("seed", "options", "sent"), [(5, {}, nj.SENT), (6, {"heavy": 3, "block": 200}, 3000)])
def test_link_counts_equal_brute_force(spark, monkeypatch, seed, options, sent):
    monkeypatch.setattr(nj, "SENT", sent)
    w = [f"t{k}" for k in range(60)]
    triangle = [(900, " ".join(w)), (901, " ".join(w[:-1])), (902, " ".join(w[1:])), (903, " ".join(w[1:]))]
    rows = corpus(seed) + triangle
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nj.link_counts(docs, **options).collect())
    assert got == brute_links(rows)
    assert {r[0]: r[2] for r in got if r[0] >= 900} == {900: 3, 901: 3, 902: 3, 903: 3}
