"""The prefix trie against a plain dictionary of prefixes, and LOUDS against its own definition."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from faultline.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        made[c] = tuple(convs.get(first, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []
    for key, own in members.items():
        below, todo = [], [key]
        while todo:
            k = todo.pop()
            below.append(k)
            todo += children[k]
        ends = ",".join(map(str, sorted(c for c in own if len(made[c]) == len(key))))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children[key]), sum(not children[k] for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def conversations(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-20, 200), n, replace=False).tolist():
        for k in range(int(rng.integers(1, 12))):
            same = rng.random() < 0.5
            rows.append((c, k if rng.random() < 0.9 else None, ["user", "assistant", None, ""][int(rng.integers(0, 4)) if not same else k % 2], None if rng.random() < 0.1 else "hello" if same else f"téxt {rng.integers(0, 3)}"))
    return rows + rows[:30] + [(None, 0, "user", "nobody's"), (300, None, None, None), (305, 0, "a", "bc"), (310, 0, "ab", "c")]


@pytest.mark.parametrize("options", [{}, {"least": 3, "shard": 10}, {"least": 5, "depth": 2, "shard": 4}, {"least": 10**9, "depth": 1}, {"least": 0, "upper": 4}])
def test_equals_plain(spark, options):
    """Heavy levels, bands and shards of any size give the same rows; null and equal turns, negative ids and rows without id are there."""
    rows = conversations(3)
    got = found(T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **options))
    assert got == plain(rows)


def test_long_conversation_and_text(spark):
    rows = [(c, k, "user", "x" * 200_000 if k == 3 else f"{k % 7}") for c in (5, 6, 1000) for k in range(400)]
    assert found(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), depth=100)) == plain(rows)


def test_empty_and_clashing_columns(spark):
    assert found(T.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = conversations(4, 20)
    more = spark.createDataFrame([(*r, 1, "x", 2, b"n") for r in rows], SCHEMA + ", depth int, top string, place int, name binary")
    assert found(T.prefix_trie(more)) == plain(rows)


def test_louds():
    """Bits, ranks and children of a small forest: a(b(d), c), e."""
    names = np.array([b"d", b"a", b"e", b"c", b"b"], "S16")
    parents = np.array([b"b", b"?", b"?", b"a", b"a"], "S16")
    forest, at = T.Louds.of(names, parents)
    assert [names[k].decode() for k in at] == ["a", "e", "b", "c", "d"]
    assert "".join(map(str, forest.bits)) == "110" + "110" + "0" + "10" + "0" + "0"
    assert forest.parent.tolist() == [-1, 0, 0, 1, 1, 3] and forest.degree.tolist() == [2, 2, 0, 1, 0, 0] and forest.levels == [0, 1, 3, 5, 6]
    assert forest.child(0, b"a") == 1 and forest.child(1, b"c") == 4 and forest.child(3, b"d") == 5 and forest.child(1, b"z") is None and forest.child(5, b"a") is None
    assert forest.rolled_up(np.ones(6, np.int64)).tolist()[1:] == [4, 1, 2, 1, 1]


def test_no_nodes():
    forest, at = T.Louds.of(np.array([], "S16"), np.array([], "S16"))
    assert len(at) == 0 and forest.bits.tolist() == [0] and forest.rolled_up(np.zeros(1, np.int64)).tolist() == [0]
