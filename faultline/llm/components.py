"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import materialize, release

from .workers import claim

#: Nodes whose sets a task holds before it hands them on, and links that one task may join at last.
HELD, GRAPH = 1 << 20, 1 << 17


def find(root: dict[int, int], node: int) -> int:
    """The smallest node of a node's set; the way there is halved."""
    while (up := root.setdefault(node, node)) != node:
        root[node] = root[up]
        node = root[node]
    return node


def grouped(links: DataFrame, held: int = HELD) -> DataFrame:
    """Links a, b (a > b) that join in each task what its own links join: union-find, so there are fewer links than nodes."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(root: dict[int, int]) -> pa.RecordBatch:
        pairs = [(n, r) for n in root if (r := find(root, n)) != n]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("components")
        root: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(root, a), find(root, b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > held:
                yield stars(root)
                root.clear()
        yield stars(root)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, *, graph: int = GRAPH) -> DataFrame:
    """node and root (the smallest node that links reach) of links a, b of type long.

    Tasks group their own links first. If no more than `graph` links are left, one task joins
    them, in bounded memory; the result is that of the way below. Else: alternating large-star and small-star steps: every node learns the smallest of its
    neighbours and hands its larger, then its smaller neighbours over to it, until the links
    are stars around roots. Rounds grow with the logarithm of the longest chain. Each round is
    written, so a lost executor costs one round at most; the links never meet in one place.
    Smallest neighbours are written too: joins are of two plain shuffles then, which Spark
    splits where a star is very large. What a round has read is deleted after it.
    """
    first = materialize(grouped(links))
    if first.count() <= graph:
        done = materialize(grouped(first.repartition(1), 2 * graph))
        release(first)
        return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
    star = materialize(first.distinct())
    release(first)
    mark = _state(star)
    while mark[0]:
        both = star.union(star.select("b", "a"))
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, both["a"] == least["u"]).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        own = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(own, large["a"] == own["u"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        after = materialize(small.where("a <> b").distinct())
        release(star, least, large, own)
        star, now = after, _state(after)
        if now == mark:
            break
        mark = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(star: DataFrame) -> tuple:
    """Count and order-free digest of the links."""
    h = F.xxhash64("a", "b")
    return tuple(star.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(F.pmod(h, F.lit(2**32)))).first())
