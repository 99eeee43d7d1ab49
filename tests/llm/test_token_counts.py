import random

import public_tokenizers
from tokenizers import Tokenizer, models

from faultline.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference(vocabulary):
    """The same model in the tokenizers library, with single bytes for unknown characters."""
    items = [("<unk>", 0.0), *vocabulary.items(), *[(f"<0x{b:02X}>", -99.0) for b in range(256)]]
    return Tokenizer(models.Unigram(items, 0, True))


def test_terminal_counts_equal_the_library():
    vocabulary, rng = tc.piece_vocabulary(PATH), random.Random(3)
    own, lib = tc.Counter(vocabulary), reference(vocabulary)
    words = sorted({"".join(rng.choice("abcdetherinéß日🤖-1") for _ in range(rng.randint(1, 14))) for _ in range(1500)} | {"a" * 700, "the", "there", "thereof"})
    for word, n in own.terminal_counts(words):
        want = sum(len(t.encode()) if t == "<unk>" else 1 for t in lib.encode(tc.MARK + word, add_special_tokens=False).tokens)
        assert n == want, word


def brute(vocabulary, word):
    """Best (score, tokens) by trying every cut of a short word."""
    if not word:
        return 0.0, 0
    return max(((vocabulary[word[:k]] + s, n + 1) for k in range(1, len(word) + 1) if word[:k] in vocabulary for s, n in [brute(vocabulary, word[k:])]), key=lambda x: x[0])


def test_small_vocabulary_by_brute_force():
    vocabulary = {tc.MARK: -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -4.0, tc.MARK + "a": -3.3, "aab": -5.0}
    own, rng = tc.Counter(vocabulary), random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    assert list(own.terminal_counts(words)) == [(w, brute(vocabulary, tc.MARK + w)[1]) for w in words]


def test_table(spark):
    docs = spark.createDataFrame([(1, "the cat", "x"), (2, None, "x"), (3, " \n", "x"), (1, "the cat", "x"), (None, "zzz 日本", "x")], "doc_id long, text string, n_tokens string")
    own = tc.Counter(tc.piece_vocabulary(PATH))
    want = sorted(((i, *own.batch([t or ""])[0]) for i, t, _ in docs.collect()), key=str)
    assert sorted((tuple(r) for r in tc.token_counts(docs, PATH).collect()), key=str) == want
    assert tc.token_counts(docs.where("false"), PATH).collect() == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 400)
    own = tc.Counter({"a": -1.0, tc.MARK: -1.0})
    assert [own.batch([t]) for t in ("a aa aaa aaaa", "a b", "aa")] == [[(4, 14)], [(2, 4)], [(1, 3)]]
    assert len(own.known) <= 4
