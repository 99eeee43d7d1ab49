"""Every stage of the corpus pipeline against brute force, on a small folder of tables."""

import collections
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import quality

from .test_decontaminate import brute as brute_hits
from .test_ngram_join import brute as brute_classes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    items = [(k, " ".join(rng.choice(vocab) for _ in range(14))) for k in range(4)]
    for i in range(220):
        good = rng.random() < 0.75
        words = [rng.choice(vocab) if good else rng.choice("xqz") * rng.randint(1, 6) + "!!" for _ in range(rng.randint(20, 120))]
        if good and docs and rng.random() < 0.3:
            words = docs[rng.randrange(len(docs))][1].split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
        if rng.random() < 0.1:
            words[5:5] = items[rng.randrange(4)][1].split()
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words), "en", "s", 1))
        labels.append((i, int(good), 0))
    docs += [(900, None, "en", "s", 0), (901, "", None, None, 0)]
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]

    predicted = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if predicted[r.doc_id]}
    now = stages["quality"](spark, docs, folder).cache()
    assert now.columns == names and {r.doc_id: r.text for r in now.collect()} == kept

    groups = collections.defaultdict(list)
    for i, t in kept.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    kept = {i: kept[i] for _, i in map(min, groups.values())}
    now = stages["exact_dedup"](spark, now, folder).cache()
    assert now.columns == names and {r.doc_id: r.text for r in now.collect()} == kept

    kept = {i: kept[i] for i, _, c in brute_classes(list(kept.items())) if i == c}
    now = stages["near_dedup"](spark, now, folder).cache()
    assert now.columns == names and {r.doc_id: r.text for r in now.collect()} == kept

    before = len(kept)
    kept = {r[0]: kept[r[0]] for r in brute_hits(list(kept.items()), items, 10) if not r[-1]}
    now = stages["decontaminate"](spark, now, folder).cache()
    assert now.columns == names and {r.doc_id: r.text for r in now.collect()} == kept and 20 < len(kept) < before

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in kept.items()}
    assert {r.doc_id: r.n_tokens for r in stages["encode"](spark, now, folder).collect()} == want
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_odd_tables(spark, tables, tmp_path):
    """Empty tables, repeated and null ids, columns with the names that operators use themselves, and one very long text."""
    folder, items = tables
    base = f"file://{tmp_path}"
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(300)]
    good = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").collect()
    long = " ".join(rng.choice(vocab) for _ in range(400_000))
    rows = [(r.doc_id % 40, r.text, 1, "d", 2, b"b", 3.0, "x") for r in good] + [(None, good[0].text, 1, "d", 2, b"b", 3.0, "x"), (None, None, None, None, None, None, None, None), (77, long, 1, "d", 2, b"b", 3.0, "x"), (77, long + " end", 1, "d", 2, b"b", 3.0, "x")]
    schema = "doc_id long, text string, node int, digest string, root int, id binary, score double, block string"
    for name, table in (("documents", spark.createDataFrame(rows, schema)), ("labels", spark.read.parquet(f"{folder}/labels.parquet")), ("benchmark", spark.read.parquet(f"{folder}/benchmark.parquet"))):
        table.write.parquet(f"{base}/full/{name}.parquet")
        table.where("false").write.parquet(f"{base}/none/{name}.parquet")
    docs = spark.read.parquet(f"{base}/full/documents.parquet")
    names, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now.count(), stage(spark, now, f"{base}/full").cache()
        assert now.columns == names and 0 < now.count() <= before, name
    told = {(r.doc_id, r.text) for r in now.collect()}
    assert told <= {(r[0], r[1]) for r in rows} and sum(len(t or "") > 10**6 for _, t in told) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, f"{base}/full").count() == len(told) == now.count()
    assert corpus_pipeline.run(spark, f"{base}/none").collect() == []
    # Without labels nothing is rejected, without a benchmark nothing is contaminated.
    free = spark.createDataFrame([(k, f"text number {k} of some words") for k in range(5)], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, free, f"{base}/none").count() == 5 and stages["decontaminate"](spark, free, f"{base}/none").count() == 5
