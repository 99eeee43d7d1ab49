"""Ids of any type, repeated and null ids, clashing columns, and how rows are dealt to tasks."""

import random

import numpy as np
import public_tokenizers
import pytest

from faultline.llm import bpe, decontaminate, exact_dedup, language, ngram_join, pii, quality, token_counts
from faultline.llm.rows import digest, without
from faultline.sources.scratch import materialize, release
from pyspark.sql import functions as F

W = [f"w{k}" for k in range(400)]


def text(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(W) for _ in range(n))


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", text(1), 1), ("a", text(1), 1), (None, None, 1), ("c", text(2), 1)], "doc_id string, text string, id int")
    items = spark.createDataFrame([("q1", text(2)), (None, text(1))], "item_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("c", 0)], "doc_id string, quality int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = {
        "quality": quality.classify(docs, labels), "dedup": exact_dedup.exact_dedup(docs), "counts": token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
        "hits": decontaminate.contamination(docs, items), "bpe": bpe.round_trip(docs, path), "join": ngram_join.near_duplicates(docs), "links": ngram_join.link_counts(docs), "pii": pii.find_pii(docs),
        "lang": language.language_id(docs.withColumn("lang", F.lit("xx"))),
    }
    for name, df in made.items():
        assert sorted((r.doc_id for r in df.collect()), key=str) == ["None", "a", "b", "c"] or sorted((str(r.doc_id) for r in df.collect())) == ["None", "a", "b", "c"], name
    assert {r.doc_id: r.component_id for r in made["join"].collect()} == {"a": "a", "b": "a", "c": "c", None: None}
    assert {r.doc_id: (r.n_items, r.contaminated) for r in made["hits"].collect()} == {"a": (0, True), "b": (0, True), "c": (1, True), None: (0, False)}


def test_rows_are_told_apart_by_id_and_text(spark):
    near = text(5).split()
    near[0] = "other"
    rows = [(1, text(5)), (1, " ".join(near)), (1, text(6)), (1, text(6)), (2, text(6)), (None, text(7)), (None, text(7)), (3, text(7)), (None, text(8)), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, id int").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, text(5)), (1, " ".join(near)), (1, text(6)), (None, text(7)), (None, text(8)), (4, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(docs).collect()), key=str)
    one = min([text(5), " ".join(near)], key=lambda t: spark.range(1).select(digest(F.lit(t))).first()[0])
    assert kept == sorted([(1, one), (1, text(6)), (3, text(7)), (None, text(8)), (4, None), (4, None)], key=str)
    bad = spark.createDataFrame([(9, text(6))], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bad)
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for _, t in rows if t != text(6))


def test_names_are_ranks_however_rows_are_dealt(spark):
    rows = [(i, text(i % 60, 900)) for i in range(150)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def named(n):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            profile, identity = exact_dedup.block_names(docs.repartition(n), block_bytes=64)
            return sorted(tuple(r) for r in profile.join(identity, "row").select("id", "level", "name").collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert named(1) == named(3) == named(7)


def test_a_passage_dealt_once_to_each_task_is_heavy(spark):
    line = [f"l{k}" for k in range(30)]
    rows = [(i, " ".join([*text(i, 20).split(), *line, *text(1000 + i, 20).split()])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 100):
        texts = ngram_join._texts(docs.repartition(n), "doc_id", "text")
        profile = materialize(ngram_join._profile(texts, 0, 5, 64, 8))
        flags, bits = ngram_join._flags(profile, 64, ngram_join.FLAGS)
        s = ngram_join.shingles(" ".join(line))
        assert len(s) == 26 and ngram_join._is_heavy(s, flags, bits, 8).all()
        found.append((sorted(x for r in profile.where("heavy is not null").collect() for x in r.heavy), flags.tobytes()))
    assert found[0] == found[1] and len(found[0][0]) == 26


def test_blocks_hand_on_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS", 7)
    monkeypatch.setattr(ngram_join, "FLUSH", 100)
    rows = [(i, text(i // 4) + " " + str(i)) for i in range(40)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 4 * 4 for i in range(40)}


def test_several_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 6)
    rng = random.Random(3)
    rows = []
    for i in range(140):
        w = text(7000 + i % 7, 60).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    from .test_ngram_join import brute

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(docs, heavy=4).collect()) == brute(rows)


def test_release_deletes_only_scratch(spark, tmp_path):
    df = materialize(spark.range(5).toDF("id"))
    files = df.inputFiles()
    release(df, None)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(*files).count()
    spark.range(3).write.parquet(f"file://{tmp_path}/own")
    own = spark.read.parquet(f"file://{tmp_path}/own")
    release(own)
    assert own.count() == 3


def test_without_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "a", 4), (2, None, 5)], "doc_id long, text string, `__key_id` int")
    keys = docs.select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest"))
    none = keys.where("false")
    assert without(docs, none, none).count() == 5
    assert without(docs.drop("__key_id"), keys.where("id = 2"), keys.where("id = 1").distinct()).count() == 3


def test_sampling_is_bounded_for_repeated_rows(spark):
    rows = [(None, "the ing wher", "aa")] * 3000 + [(i, text(i), "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = language.train
    try:
        language.train = lambda x, y, names, **kw: seen.append(len(x)) or train(x, y, names, epochs=1)
        language.fit(docs, sample_docs=100)
    finally:
        language.train = train
    assert seen[0] <= 2 * 250
    labelled = spark.createDataFrame([(1, "good words here " * 20, 1)] * 2000 + [(2, "xq!! zz " * 30, 1), (3, "more good words", 1), (4, "zq !! x", 1)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert quality.score(labelled, quality.fit(labelled, labels)).count() == 2003
    assert np.isfinite([r.score for r in quality.score(labelled, quality.fit(labelled, labels)).collect()]).all()
