import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import token_shards as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "the cat sat on the mat. " * 200), (3, None), (4, ""), (9, "a  b   c <|endoftext|> é日"), (7, "the cat sat on the mat. " * 40), (-2, "x"), (None, "null id"), (12, "repeat repeat " * 500)]


def expected(rows):
    t, start = Tokenizer.from_file(PATH), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        yield i, start, ids
        start += len(ids)


@pytest.mark.parametrize("shard_ids", [1, 300, 1_000_000])
def test_files_give_back_the_ids(spark, tmp_path, shard_ids):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, start int")
    path = f"file://{tmp_path}/shards"
    ts.write_token_shards(docs, PATH, path, shard_ids=shard_ids)
    want = {(i, s, tuple(ids)) for i, s, ids in expected(ROWS)}
    assert {(r.doc_id, r.start, tuple(r.token_ids)) for r in ts.read_token_shards(spark, path).collect()} == want
    crc = {(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want}
    assert {tuple(r) for r in ts.shard_digests(spark, path).collect()} == crc
    for row in spark.read.parquet(path).collect():
        ids = {tuple(x) for _, _, x in want}
        lengths = np.frombuffer(row.doc_lengths, "<u4").tolist()
        for k, n in enumerate(lengths):
            assert tuple(ts.token_slice(row, k, 0, n)) in ids
            if n > 20:
                assert ts.token_slice(row, k, 7, 19) == ts.token_slice(row, k, 0, n)[7:19]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ts.write_token_shards(docs, PATH, f"file://{tmp_path}/none")
    assert ts.shard_digests(spark, f"file://{tmp_path}/none").collect() == []


def test_grammar_round_trip_and_gain():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50257, rng.integers(2, 6)) for _ in range(50)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 50, 4000)]).astype("<u2")
    lengths = np.array([0, 1, 5, 0, len(ids) - 6, 0], dtype="<u4")
    symbols, sizes, rules = ts.compress(ids, lengths, 50257)
    n = ts.expansion_lengths(rules, 50257)
    pool, starts = ts.expansions(rules, 50257, n)
    assert (ts.expand(symbols, pool, starts, n, 50257) == ids).all()
    assert sizes.sum() == len(symbols) and list(sizes[[0, 3, 5]]) == [0, 0, 0]
    assert len(symbols) + rules.size < 0.5 * len(ids)


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(ts, "TEXT", 40)
    own, lib = ts.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "the cat, the dog", "naïve  façade\n\tx", "don't we'll <|endoftext|> it's", "'s 's a' 'b", "日本 ՘ cat՘ a՘. 1a a1 a.b a..", "one two two, one", "x" * 99, "x a.\nThe b!\nÉa c.\n\nd e.\nf\ng the\nThe.", "dogs' a.b. ...x y... z.\n\nq \x01 a.", "a.\x01b c,", "end. ", "end.", ",", "a, b, c,, 'd' e\n.f", "x.\né.\n ö"]
    assert [np.frombuffer(b, "<u2").tolist() for t in texts * 3 for b in own.batch(pa.array([t, "one two"]))[:1]] == [lib.encode(t, add_special_tokens=False).ids for t in texts * 3]
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeèß🤖\n\t  ' 0129.,!-日क्֋") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for k in range(0, 600, 20):
        assert [np.frombuffer(b, "<u2").tolist() for b in own.batch(pa.array(texts[k : k + 20]))] == [lib.encode(t, add_special_tokens=False).ids for t in texts[k : k + 20]]


def left_over(symbols, sizes):
    """The most uses, without overlaps, that a pair still has."""
    uses, at = {}, 0
    for n in sizes.tolist():
        own, seen = symbols[at : at + n].tolist(), {}
        for k, pair in enumerate(zip(own, own[1:], strict=False)):
            if seen.get(pair, -2) < k - 1:
                seen[pair] = k
                uses[pair] = uses.get(pair, 0) + 1
        at += n
    return max(uses.values(), default=0)


@pytest.mark.parametrize(("base", "kind"), [(50257, "<u2"), (70000, "<u4"), (300, "<u2")])
def test_replacement_goes_on_to_the_end(base, kind):
    rng = np.random.default_rng(base)
    phrases = [rng.integers(0, base, rng.integers(1, 30)) for _ in range(60)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 60, rng.integers(1, 40))]) for _ in range(80)] + [np.full(999, 7), np.empty(0, np.int64), np.array([7])]
    ids, lengths = np.concatenate(docs).astype(kind), np.array([len(d) for d in docs], "<u4")
    for symbols, least in ((1 << 31, 4), (1 << 31, 2), (base + 50, 4), (base, 4)):
        coded, sizes, rules = ts.compress(ids, lengths, base, symbols, least)
        n = ts.expansion_lengths(rules, base)
        pool, starts = ts.expansions(rules, base, n)
        assert (ts.expand(coded, pool, starts, n, base) == ids).all() and base + len(rules) <= symbols
        assert coded.itemsize == (2 if base + len(rules) <= 1 << 16 else 4) and sizes.sum() == len(coded)
        if symbols > base + 50:
            assert left_over(coded, sizes) < least
        own, at = np.concatenate([np.ones(base, np.int64), n]), 0
        for k, m in zip(sizes.tolist(), lengths.tolist(), strict=True):
            assert own[coded[at : at + k]].sum() == m
            at += k


def test_wide_symbols_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    path = f"file://{tmp_path}/wide"
    ts.write_token_shards(docs, PATH, path, symbols=1 << 31, least_uses=2)
    assert {(r.doc_id, r.start, tuple(r.token_ids)) for r in ts.read_token_shards(spark, path).collect()} == {(i, s, tuple(ids)) for i, s, ids in expected(ROWS)}


def test_encoder_remembers_pieces(monkeypatch):
    import random

    own, lib, asked = ts.Encoder(PATH), Tokenizer.from_file(PATH), []
    distinct = own._distinct
    monkeypatch.setattr(own, "_distinct", lambda pieces: asked.append(len(pieces)) or distinct(pieces))
    a, b = ["the cat sat, on a mat.", "one two", ""], ["two cat sat", "a new mat. one"]
    for texts in (a, a, b):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.batch(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == 2 and asked[1] == 2  # of the last batch "new" is new, and "one", which only began a text
    rng = random.Random(7)
    for bound in (0, 200, 2_000, 1 << 30):
        monkeypatch.setattr(ts, "REMEMBER", bound)
        for _ in range(12):
            texts = [" ".join("".join(rng.choice("abé. ,!") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 9))) for _ in range(9)]
            assert [np.frombuffer(x, "<u2").tolist() for x in own.batch(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
            assert own.known.nbytes + own.lists.nbytes <= max(bound, 100)
