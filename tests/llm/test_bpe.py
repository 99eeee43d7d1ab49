import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from faultline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "don't <|endoftext|> a<|endoftext|>b", "   x  y   z  ", " a\t \tb", "a \n y", "  ", "a  ", "日本語 テキスト ՘౜", "\n\n\n a",
    "the" * 3000, "-" * 500, "a" * 1001, "'ll'll I'Ll", "the cat", "the cat", " a   b　c", "🤖👩‍👩‍👧 é",
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(texts):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for i in ids]


def test_round_trip_equals_the_library(spark):
    docs = spark.createDataFrame([(k, x, "a", 1) for k, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, id int")
    got = bpe.round_trip(docs, PATH).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(TEXTS)
    assert bpe.round_trip(docs.where("false"), PATH).collect() == []


def test_random_texts_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20000)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeèß🤖\n\t  ' 0129.,!-日क्֋") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    own, t = bpe.Coder(PATH), Tokenizer.from_file(PATH)
    for k in range(0, len(texts), 20):
        for x, (n, ids, text) in zip(texts[k : k + 20], own.batch(texts[k : k + 20]), strict=True):
            want = t.encode(x, add_special_tokens=False).ids
            assert (n, ids, text) == (len(want), ",".join(map(str, want)), t.decode(want, skip_special_tokens=False))
        assert len(own.rest) <= 50 + 20 * 41 and len(own.head) <= 50 + 20 * 41


def test_may_follow_is_what_the_merges_say():
    v, rng = bpe.Vocabulary(PATH), random.Random(6)
    ids = sorted(v.id_of.values())[:3000]
    for _ in range(3000):
        u, t = rng.choice(ids), rng.choice(ids)
        assert v.may_follow(u, t) == (v.encode_by_merges(v.bytes_of[u] + v.bytes_of[t]) == [u, t])


def test_encode_and_decode_tables(spark):
    docs = spark.createDataFrame([(1, "the cat <|endoftext|>"), (2, None), (None, "é")], "doc_id long, text string")
    ids = bpe.encode(docs, PATH)
    assert {(r.doc_id, r.text) for r in bpe.decode(ids, PATH).collect()} == {(1, "the cat <|endoftext|>"), (2, ""), (None, "é")}
