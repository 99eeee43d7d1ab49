import collections
import hashlib
import re

import pytest

from faultline.llm.exact_dedup import drop_exact_duplicates, exact_dedup


def brute(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    return sorted((i, min(v)[1], len(v), i == min(v)[1], hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, i in v)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b c"), (4, None), (5, ""), (6, " \t\n"), (7, "é" * 50), (8, "é" * 49 + "e"),
    (9, "x" * 1000), (10, "x" * 999 + "y"), (11, "x" * 1000 + "\x0b"), (12, "x" * 1000), (13, "abcd" * 16), (14, "abcd" * 15 + "abce"), (15, " abc"),
]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 8}, {"block_bytes": 8, "hash_bits": 2}, {"block_bytes": 3, "hash_bits": 0}])
def test_equals_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in ROWS], "doc_id long, text string, name string, h int")
    got = sorted(tuple(r) for r in exact_dedup(docs, **options).collect())
    assert got == brute(ROWS)


def test_repeated_rows_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, "a", 8)], "doc_id long, text string, kept int")
    got = exact_dedup(docs).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {3}
    assert exact_dedup(docs.where("false")).collect() == []
    docs = spark.createDataFrame([(1, "a", 7), (2, " a", 9)], "doc_id long, text string, kept int")
    assert [tuple(r) for r in drop_exact_duplicates(docs).collect()] == [(2, " a", 9)]
