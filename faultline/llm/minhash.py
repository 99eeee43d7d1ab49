"""Near-duplicate classes by SuperMinHash signatures.

Every shingle ranks the signature's slots by a permutation of its own; its value in a slot is
that rank plus a random fraction, and a slot keeps the least value of the set's shingles. Ranks
of one shingle differ from slot to slot, so slots depend on one another in a way that makes the
estimate vary less than with independent hashes. Ranks are gone through in turn, for all shingles
of many sets at once: a set whose slots are all filled in the first rounds can't change any more,
so long sets take a round or two. Permutations are j -> (a j + b) mod SLOTS, SLOTS being prime:
any two slots have any two ranks equally often, as under all permutations.

Signatures are cut into bands; sets that agree in a whole band meet in a bucket. Equal sets are
one node. In each bucket nodes are first compared with its smallest one, on full sets: for each
node the partner that it meets in most bands, then those that this hasn't connected already.
Buckets that are in one component then are done. What is left of small ones are pairs across
components; the nodes of large ones are compared by pivots (see the n-gram join), so no
bucket's pairs are ever listed. Every link is confirmed by the full sets' exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.sources.scratch import materialize, release

from .components import components
from .ngram_join import _dealt, _hot_links, _sets, _start, _texts, _verify, node_of, shingles

#: Words of a shingle and least similarity, as a fraction.
WORDS, SIMILAR = 3, (85, 100)
#: Slots of a signature (a prime), bands of it and slots of a band. At a similarity of 0.85 a slot agrees with that
#: probability, so a link meets in no band with (1 - 0.85^6)^48, about 10^-10.
SLOTS, BANDS, ROWS = 293, 48, 6
#: Shingles, and sets, that get their signatures at once.
FLUSH, SETS = 400_000, 2048
#: Entries of a block of buckets, about.
BLOCK = 1_000_000
#: Pairs across components are listed for buckets of so many nodes at most.
SMALL = 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` values for each set (none of them empty): rank in the upper 16 bits, fraction below."""
    e = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = _mix(e + _M3)
    step = (np.uint64(1) + (h >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64)
    slot = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
    out = np.full((len(sets), slots), NONE)
    flat, open_ = out.reshape(-1), np.ones(len(sets), bool)
    for rank in range(slots):
        value = np.uint64(rank) << np.uint64(48) | _mix(e + np.uint64((rank + 2) * int(_M3) % 2**64)) >> np.uint64(16)
        np.minimum.at(flat, own * slots + slot, value)
        before = np.flatnonzero(open_)
        open_[before] = (out[before] == NONE).any(axis=1)
        left = open_[own]
        if not left.any():  # all slots hold ranks up to this one: later ones are larger
            break
        e, own, step, slot = e[left], own[left], step[left], (slot[left] + step[left]) % slots
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each set and band."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _M3), (len(signature), bands))
    for k in range(rows):
        key = _mix((key ^ parts[:, :, k]) + _M3)
    return key


def _profile(texts: DataFrame, salt: int, width: int, blocks: int) -> DataFrame:
    """Rows of lists: either ids, digests, n, nodes and guards of documents, or the band keys of sets, with their nodes, that fall into a block."""
    kind = texts.schema["id"].dataType
    lists = [("ids", pa.list_(to_arrow_type(kind))), *[(c, pa.list_(pa.int64())) for c in ("digests", "n", "nodes", "guards")]]
    out = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), *lists])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def entries() -> pa.RecordBatch:
            keys = band_keys(signatures(held)).reshape(-1)
            order = np.argsort(keys)
            keys = keys[order]
            number, columns = _dealt(((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32), keys, np.repeat(np.array(names, np.int64), BANDS)[order])
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *[pa.array(c, pa.binary()) for c in columns], *[pa.nulls(len(number), t) for _, t in lists]], schema=out)

        for b in batches:
            n, node, guard = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), width)
                name = node_of(s, salt) if len(s) else None
                n.append(len(s))
                node.append(name)
                guard.append(xxhash.xxh64_intdigest(s.tobytes(), seed=salt + 1) >> 1)
                if len(s) and name not in seen:
                    seen.add(name)
                    held.append(s)
                    names.append(name)
                    size += len(s)
                    if size > FLUSH or len(held) >= SETS:
                        yield entries()
                        held, names, size = [], [], 0
                        if len(seen) > FLUSH:  # a set that comes again is sent again, and told from others by its node
                            seen.clear()
            row = [b.column(0).to_pylist(), b.column(2).to_pylist(), n, node, guard]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % blocks], pa.int32()), *[pa.nulls(1, pa.binary())] * 2, *[pa.array([v], t) for v, (_, t) in zip(row, lists, strict=True)]], schema=out)
        if held:
            yield entries()

    types = ", ".join([f"ids array<{kind.simpleString()}>", *[f"{c} array<long>" for c, _ in lists[1:]]])
    return texts.select("id", "text", "digest").mapInArrow(cut, f"block int, keys binary, owners binary, {types}")


def _buckets(block: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, pivot (the smallest node) and size of the buckets of a block that have two nodes or more."""
    held: list[np.ndarray] = []
    for b in block:
        keys, owners = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in b.column(c)]) for c, t in (("keys", np.uint64), ("owners", np.int64)))
        held.append(np.rec.fromarrays([keys, owners], names="key,node"))
    both = np.concatenate(held)
    order = np.lexsort((both["node"], both["key"]))
    key, node = both["key"][order], both["node"][order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # tasks may have seen the same set
    key, node = key[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    often, pivot = np.repeat(size, size), np.repeat(node[start], size)
    some = often > 1
    yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (key, node, pivot, often)], names=["key", "node", "pivot", "size"])


def _links(texts: DataFrame, rows: DataFrame, buckets: DataFrame, salt: int, width: int, small: int) -> DataFrame:
    """Links that connect whatever similar nodes of the buckets connect."""
    edges = materialize(buckets.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("bands")))
    sets = _sets(texts, rows, buckets.select("node").distinct(), salt, width)
    best = edges.groupBy("node").agg(F.max_by("pivot", F.struct("bands", -F.col("pivot"))).alias("b")).select(F.col("node").alias("a"), "b")
    links = materialize(_verify(best, sets, SIMILAR))
    roots = components(links)

    def rooted(df: DataFrame, column: str, out: str) -> DataFrame:
        known = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return df.join(known, df[column] == known["__node"], "left").withColumn(out, F.coalesce("__root", column)).drop("__node", "__root")

    rest = rooted(rooted(edges, "node", "x"), "pivot", "y").where("x <> y").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = links.union(materialize(_verify(rest, sets, SIMILAR)))
    roots = components(links)
    # Buckets that hold more than one component.
    placed = materialize(rooted(buckets, "node", "root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    placed = materialize(placed.join(mixed, "key", "left_semi").select("key", "node", "root", "size"))
    few = placed.where(F.col("size") <= small)  # a row meets fewer than `small` others
    other = few.select("key", F.col("node").alias("b"), F.col("root").alias("y"))
    pairs = few.select("key", F.col("node").alias("a"), F.col("root").alias("x")).join(other, "key").where("a < b AND x <> y").select("a", "b").distinct()
    known = edges.select(F.col("pivot").alias("a"), F.col("node").alias("b"))  # pivots are smaller
    links = links.union(materialize(_verify(pairs.join(known, ["a", "b"], "left_anti"), sets, SIMILAR)))
    many = placed.where(F.col("size") > small).groupBy("node").agg(F.count("*").alias("bands"))
    # Pivots are picked first where most bands meet: in the middle of a group.
    hot = materialize(sets.join(many, "node").select("node", "shingles", F.lit(BANDS).alias("n"), (F.lit(BANDS) - F.col("bands")).alias("rare")))
    more = _hot_links(hot, SIMILAR)
    return links if more is None else links.union(more)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, small: int, block: int) -> DataFrame:
    """id, digest, n and root (the same for rows that links connect; null without words) of each row."""
    texts = _texts(docs, id_col, text_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, math.ceil(docs.count() * BANDS / block))
    for salt in range(0, 100, 2):
        profile = materialize(_profile(texts, salt, width, blocks))
        lists = profile.where("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "digests", "n", "nodes", "guards")).alias("x"))
        rows = lists.select(F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"), "x.n", F.col("x.nodes").alias("node"), F.col("x.guards").alias("guard"))
        # Different sets under one name (none expected below 10^9 sets): take other names.
        if rows.where("node IS NOT NULL").groupBy("node").agg(F.min("guard").alias("x"), F.max("guard").alias("y"), F.min("n").alias("u"), F.max("n").alias("v")).where("x <> y OR u <> v").isEmpty():
            break
        release(profile)
    buckets = materialize(profile.where("keys IS NOT NULL").select("block", "keys", "owners").groupBy("block").applyInArrow(_buckets, "key long, node long, pivot long, size long"))
    roots = components(_links(texts, rows.drop("guard"), buckets, salt, width, small))
    release(buckets)
    some = rows.where("node IS NOT NULL").join(roots, "node", "left").select("id", "digest", "n", F.coalesce("root", "node").alias("root"))
    return some.union(rows.where("node IS NULL").select("id", "digest", "n", F.col("node").alias("root")))


def minhash_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id that links reach) and kept (component_id is the own id) of each row.

    Rows link when the Jaccard similarity of their sets of `width` word shingles is 0.85 or
    more. A text of fewer words is one shingle; null texts and texts without words have none
    and link with nothing, so their component is their own id. Rows of the same id and null
    ids keep a row each; a null id never names a component that others with an id belong to. Ids
    are of any type that has an order; other columns are ignored. An empty table gives no rows.
    """
    rows = _classes(docs, id_col, text_col, width, small, block)
    # Written, so that the join is of two plain shuffles, which Spark can split where one class has very many rows.
    least = materialize(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")))
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    got = rows.where("root IS NOT NULL").join(least, "root").select(*own, F.col("least").alias("component_id")).union(rows.where("root IS NULL").select(*own, F.col("id").alias("component_id")))
    return got.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
