"""Texts of a few million characters, whole, through the operators that other tests give shorter ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import bpe, chat, exact_dedup, ngram_join
from faultline.llm import decontaminate as dc
from faultline.llm import token_counts as tc
from faultline.llm import token_shards as ts

from .test_decontaminate import brute as brute_hits
from .test_ngram_join import brute as brute_classes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}é" for _ in range(250_000)]
    item = [f"item{k}" for k in range(14)]
    changed = list(words)
    changed[1000:1005] = ["x"] * 5
    return {1: " ".join(item + words + item), 2: " ".join(changed), 3: "\n".join(words) + "\n", 4: "z" * 400_000, 5: "short one", 6: " \t" * 500_000, 7: None}, " ".join(item)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts[0].items()), "doc_id long, text string").repartition(2).cache()


def test_exact_dedup(docs, texts):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {k: v[2] for k, v in got.items()} == {k: sha(re.sub(r"[\x20\x09-\x0D]", "", t or "")) for k, t in texts[0].items()}
    assert got[6][:2] == got[7][:2] == (6, 2) and got[3][:2] == (3, 1)


def test_decontaminate(docs, texts):
    items = docs.sparkSession.createDataFrame([(9, texts[1]), (8, "short one")], "item_id long, text string")
    got = sorted(tuple(r) for r in dc.contamination(docs, items).collect())
    assert got == sorted(brute_hits(list(texts[0].items()), [(9, texts[1]), (8, "short one")], 10)) and got[0][2] == 28


def test_ngram_join(docs, texts):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()) == sorted(brute_classes(list(texts[0].items())))


def test_tokens(spark, docs, texts):
    lib = Tokenizer.from_file(PATH)
    ids = {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in texts[0].items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    assert got == {k: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for k, x in ids.items()}
    crc = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in ts.token_shards(docs, PATH).collect()}
    assert crc == {k: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for k, x in ids.items()}
    counts = {r.doc_id: r for r in tc.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    own = tc.Counter(tc.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    each = dict(own.terminal_counts(sorted(set(texts[0][3].split()))))
    assert tuple(counts[3])[1:] == (250_000, sum(each[w] for w in texts[0][3].split())) and counts[4][1] == 1


def test_chat(spark, texts):
    turns = [("user", texts[0][1] + "</s>"), ("assistant", texts[0][4]), ("assistant", "[/INST]" * 100_000)]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.chat_digests(chat.format_chats(chat.turns_of_rows(rows))).first()
    loss = turns[1][1] + turns[2][1]
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (3, sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
