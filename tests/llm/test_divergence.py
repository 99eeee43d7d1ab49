"""The divergence audit against a plain version in Python's whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def terms(text):
    return [t.translate({k: k + 32 for k in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(rows, least=30, listed=50):
    rows = [(terms(t), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        df = Counter(t for ws, _, _ in own for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for ws, _, source in own:
            counts[source].update(w for w in ws if df[w] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            found = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items) if part == "pair" or k < listed]
    return sorted(out)


def rows_of(seed, n=160):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "ÉTÉ", "été", "x", "naïve", "東京", "a1b", "don't", "ZZ", *(f"w{chr(97 + k)}" for k in range(20))]
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words, size=rng.integers(0, 60)))
        out.append((k, text, ["en", "fr", None, ""][int(rng.integers(0, 4)) if k % 3 else 0], [None, "s1", "s2", "ŝ3", "s4"][int(rng.integers(0, 5)) if k % 3 else 1]))
    return [*out, (7, None, "en", "s1"), (7, "", "en", "only empty"), (8, None, None, None), (9, "alone", "xx", "a"), (9, "alone", "xx", "b"), (9, "alone", "xx", "b"), *out[:40]]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("chunk", "block", "bits"), [(D.CHUNK, D.BLOCK, 64), (50, 7, 64), (200, 30, 2)])
def test_equals_plain(spark, chunk, block, bits):
    """Stretches that cut documents, many blocks, and hashes that slices share change nothing."""
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(D.source_divergence(docs, least=12, listed=4, chunk=chunk, block=block, bits=bits))
    assert got == plain(rows, 12, 4) and {r[2] for r in got} == {"pair", "term"}


def test_nothing_kept_and_no_rows(spark):
    rows = rows_of(2, 20)
    got = found(D.source_divergence(spark.createDataFrame(rows, SCHEMA), least=10_000))
    assert got == plain(rows, 10_000) and all(r[2] == "pair" and r[4] == 0 for r in got)
    assert found(D.source_divergence(spark.createDataFrame([], SCHEMA))) == []


def test_clashing_columns_and_long_text(spark):
    long = "lorem Ipsum " * 200_000 + "x" * 300_000
    rows = [(k, long if k < 2 else f"lorem w{k % 3}", "la", f"s{k % 3}") for k in range(9)]
    docs = spark.createDataFrame([(*r, 1, 2, "z", 3) for r in rows], SCHEMA + ", term int, block int, value string, n int")
    assert found(D.source_divergence(docs, least=2, chunk=100_000)) == plain(rows, 2)


def test_share_of_large_counts():
    n, total = np.array([0, 5, 10**13, 8 * 10**15]), 9 * 10**15 - 1
    assert D.share(n, total).tolist() == [1 + 10**9 * (int(k) + 5) // total for k in n]


def test_slices_end_with_documents():
    data = np.frombuffer(b"ab" + "cdé f".encode() + b"g", np.uint8)
    starts, ends = D.slices(data, np.array([0, 2, 8, 9]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "cdé", "f", "g"]
