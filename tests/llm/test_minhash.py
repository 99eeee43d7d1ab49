"""SuperMinHash classes against all pairs of full sets, and signatures against a plain form."""

import re

import numpy as np
import pytest

from faultline.llm import minhash as M
from faultline.llm.components import components

SCHEMA = "doc_id long, text string"


def sets_of(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    out = [(d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def documents(seed, groups=12, copies=9):
    """Groups of copies with some words changed: links, chains of links, and pairs just off the bound."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.choice([7, 14, 40, 120, 400])))]
        for _ in range(copies):
            own = list(words)
            for k in rng.integers(0, len(own), int(rng.integers(0, max(2, len(own) // 18)))):
                own[k] = f"v{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.3:
                words = own
    return rows


ODD = [(900, None), (901, ""), (902, " \t "), (903, "One"), (904, "one\n"), (905, "a b"), (906, "A  B"), (None, "one"), (None, "lonely words here now"), (3, "one"), (3, "one"), (907, "x" * 200_000), (908, "word " * 60_000), (909, "word " * 50_000)]


@pytest.mark.parametrize(("small", "seed"), [(M.SMALL, 1), (2, 2), (0, 3)])
def test_equals_all_pairs(spark, small, seed):
    """Small bounds send all unfinished buckets to the pivots; nulls, empty, short and long texts and repeated rows are there."""
    rows = documents(seed) + ODD
    assert found(M.minhash_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), small=small)) == plain(rows)


def test_large_group_and_clashing_columns(spark):
    """One group of copies that differ from one another more than from the first."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(150):
        own = list(words)
        for k in rng.integers(0, 300, int(rng.integers(0, 30))):
            own[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], SCHEMA + ", node int, key int, pivot string")
    got = found(M.minhash_classes(docs, small=4))
    assert got == plain(rows) and 1 < sum(r[3] for r in got) < 150


def test_no_rows_and_other_ids(spark):
    assert found(M.minhash_classes(spark.createDataFrame([], SCHEMA))) == []
    got = M.minhash_classes(spark.createDataFrame([("b", "one two three"), ("a", "ONE two three"), ("c", None)], "doc_id string, text string"))
    assert found(got) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def plain_signature(s, slots):
    out = [None] * slots
    for e in s:
        h = M._mix(np.array([e], np.uint64) + M._M3)[0]
        step, slot = 1 + (int(h) >> 32) % (slots - 1), (int(h) & 0xFFFFFFFF) % slots
        for rank in range(slots):
            v = rank << 48 | int(M._mix(np.array([(int(e) + (rank + 2) * int(M._M3)) % 2**64], np.uint64))[0]) >> 16
            k = (slot + rank * step) % slots
            out[k] = v if out[k] is None else min(v, out[k])
    return out


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 2, 30, 200)]
    assert M.signatures(sets, 23).tolist() == [plain_signature(s.tolist(), 23) for s in sets]


def test_estimate_and_recall():
    """Agreeing slots estimate the similarity; at the bound no pair of some hundred is missed by all bands."""
    rng = np.random.default_rng(1)
    missed, gaps = 0, []
    for n in (7, 20, 100, 1000):
        both = int(np.ceil(0.85 * n)) if n > 7 else 6
        sets = []
        for _ in range(150):
            pool = rng.integers(0, 2**64, n, dtype=np.uint64)
            half = both + (n - both) // 2
            sets += [pool[:half], np.concatenate([pool[:both], pool[half:]])]
        got = M.signatures(sets)
        keys = M.band_keys(got)
        missed += int((keys[::2] == keys[1::2]).any(axis=1).sum() < 150)
        gaps.append(abs(float((got[::2] == got[1::2]).mean()) - both / n))
    assert missed == 0 and max(gaps) < 0.02


def test_components_both_ways(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    small, large = ({r["node"]: r["root"] for r in components(df, graph=g).collect() if r["node"] != r["root"]} for g in (10**6, 0))
    assert small == large and small[1100] == 1000
