"""N-gram Jaccard self-join by a blocked sparse matrix product.

Documents are rows and word shingles columns of an incidence matrix; the product with its
transpose counts what two documents share. Only what can reach the bound is multiplied out:

* Equal sets are one row (a node, named by a hash of the set).
* Shingles have one global order: rare ones by hash, then heavy ones, which many nodes have.
  Of n shingles, the first n - ceil(t n) + 1 are indexed. If two sets of sizes m and n are
  similar, they share at least ceil(t (m + n) / (1 + t)) shingles, so their indexed parts share
  at least that less the larger number of shingles left out of the index.
* What is heavy is counted over all documents by a shuffle of short fingerprints, so it doesn't
  depend on how documents are dealt to tasks. A flag of a bitmap marks it; a flag that two
  shingles share makes both heavy, which changes the order, not the result.
* Columns are dealt into blocks by hash. A block is multiplied on its own and hands on partial
  overlap counts of pairs; these are added up and pairs below the size-derived bound go. A
  rare column has fewer than `heavy` nodes, so a block's pairs are in proportion to its entries.
* What is left is counted on full sets: first each node with the partner that shares most,
  then only pairs that this has not connected already.
* Nodes with heavy shingles in the index are almost nothing but heavy shingles: near copies of
  one hot text, most often. Pivots are multiplied with all of them in dense blocks of bounded
  size until every hot node is similar to a pivot or is one. Jaccard distance is a metric: if u
  is at most 1 - t from its pivot, a similar node v is at most 2 (1 - t) from that pivot. So
  what is left to test are nodes that near to a pivot of a component other than their own.

Nothing is dropped or capped: the order of shingles and the bitmap steer work, not results.
Shingles are 64-bit hashes of word hashes; overlaps are counted on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.sources.scratch import materialize, release

from .components import components
from .rows import digest, without
from .workers import claim, tidy

#: Words of a shingle and least similarity, as a fraction.
WORDS = 5
SIMILAR = (75, 100)
#: A shingle that so many different sets have is heavy.
HEAVY = 64
#: Flags of the bitmap of heavy shingles at most (32 MB) and flags for each of them at least. Beyond that the bound of
#: what is heavy doubles, up to HEAVIEST, until they fit; beyond that the bitmap fills up, and more shingles count as
#: heavy than are. Either way the result is the same.
FLAGS = 1 << 28
FLAGS_EACH = 16
HEAVIEST = 1024
#: Nodes are counted by marks of 8 bits: what so many different marks say of the number of nodes is linear counting.
MARKS = 256
#: Index entries of a block of columns, about.
BLOCK = 400_000
#: Shingles that a task holds before it hands on counts or index entries.
FLUSH = 500_000
#: Pairs that a task holds before it hands on their partial counts.
PAIRS = 1_000_000
#: Bytes of pivots' sets that are broadcast at once, and pivots of a block at most.
SENT = 8 << 20
PIVOTS = 4096
#: Words whose hashes a worker remembers, and names of sets that a task does, at most.
MEMO = 150_000

#: ASCII white space is what separates words; A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()


def _start() -> None:
    """What a task says when it begins to cut texts."""
    claim("shingles", _WORDS.clear)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; fewer words than `width` are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    if len(h) == 0:
        return h
    n = max(1, len(h) - width + 1)
    s = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        s = (s ^ (s >> np.uint64(31))) * _MIX[k % 5] + h[k : k + n]
    s = (s ^ (s >> np.uint64(32))) * _MIX[1]
    return np.unique(s ^ (s >> np.uint64(29)))


def node_of(s: np.ndarray, salt: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=salt) >> 1


def indexed(n: int, num: int = SIMILAR[0], den: int = SIMILAR[1]) -> int:
    """Shingles of n that must be indexed."""
    return n - -(-num * n // den) + 1


def similar(shared: int, m: int, n: int, num: int = SIMILAR[0], den: int = SIMILAR[1]) -> bool:
    return den * shared >= num * (m + n - shared)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), digest(F.col(text_col)).alias("digest"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another order of hashes: the first shingles of a set by hash are low, so blocks go by this one."""
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """Numbers of the blocks of mixed hashes; ascending as these are."""
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int32)


def _print(h: np.ndarray) -> np.ndarray:
    """24 bits of a mixed hash that its block doesn't depend on."""
    return h >> np.uint64(8) & np.uint64(0xFFFFFF)


def _dealt(block: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Ascending block numbers, and the bytes of each column's stretch of each block."""
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
    edges = list(zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True))
    return block[start].tolist(), [[c[a:b].tobytes() for a, b in edges] for c in columns]


def _profile(texts: DataFrame, salt: int, width: int, heavy: int, blocks: int) -> DataFrame:
    """Rows of lists: either ids, digests, n, nodes and guards of documents, or heavy shingles (keys) and about how many nodes each has.

    Every shingle goes, as 24 bits of its hash and 8 of its node, to the block of its hash,
    where its different nodes are counted. A task sends 2 * heavy nodes of a shingle at most
    from every FLUSH shingles: more of them can't make it any heavier.
    """
    least = max(1, int(MARKS * -math.expm1(-heavy / MARKS)))  # different marks of so many nodes
    kind = to_arrow_type(texts.schema["id"].dataType)
    lists = [("ids", pa.list_(kind)), *[(c, pa.list_(pa.int64())) for c in ("digests", "n", "nodes", "guards")]]
    types = ", ".join([f"ids array<{texts.schema['id'].dataType.simpleString()}>", *[f"{c} array<long>" for c, _ in lists[1:]]])
    out = pa.schema([("block", pa.int32()), ("prints", pa.binary()), *lists])
    back = pa.schema([("heavy", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), *lists])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []
        size, turn = 0, TaskContext.get().partitionId()

        def entries() -> pa.RecordBatch:
            mark = np.repeat(np.array(names, np.int64).astype(np.uint8), [len(x) for x in held])
            h = _mixed(np.concatenate(held))
            order = np.argsort(h)
            h, mark = h[order], mark[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            some = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h)))) < 2 * heavy
            h, mark = h[some], mark[some]
            number, (prints,) = _dealt(_block(h, blocks), _print(h).astype(np.uint32) << np.uint32(8) | mark)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(prints, pa.binary()), *[pa.nulls(len(number), t) for _, t in lists]], schema=out)

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
                    if size > FLUSH:
                        yield entries()
                        held, names, size = [], [], 0
                        if len(seen) > MEMO:  # a set that comes again is sent again; its node counts once all the same
                            seen.clear()
            turn += 1
            row = [b.column(0).to_pylist(), b.column(2).to_pylist(), n, node, guard]
            yield pa.RecordBatch.from_arrays([pa.array([turn * 7919 % blocks], pa.int32()), pa.nulls(1, pa.binary()), *[pa.array([v], t) for v, (_, t) in zip(row, lists, strict=True)]], schema=out)
        if held:
            yield entries()

    def count(block: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        number = size = 0
        for b in block:
            docs = b.filter(pa.compute.is_valid(b.column("ids")))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(docs.num_rows, t) for t in back.types[:2]], *[docs.column(c) for c, _ in lists]], schema=back)
            sent = b.filter(pa.compute.is_valid(b.column("prints")))
            if sent.num_rows:
                number = sent.column("block")[0].as_py()
                held.append(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in sent.column("prints")]))
                size += len(held[-1])
                if size > 2 * FLUSH:
                    held, size = [np.unique(np.concatenate(held))], 0
        if held:
            prints = np.unique(np.concatenate(held)) >> np.uint32(8)
            start = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            n = np.diff(np.append(start, len(prints)))
            often = n >= least
            if often.any():
                times = np.rint(-MARKS * np.log1p(-n[often] / (MARKS + 1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([prints[start[often]].astype(np.int64) + (number << 24)], back.types[0]), pa.array([np.maximum(times, heavy)], back.types[1]), *[pa.nulls(1, t) for _, t in lists]], schema=back)

    return texts.select("id", "text", "digest").mapInArrow(tidy(cut), f"block int, prints binary, {types}").groupBy("block").applyInArrow(count, f"heavy array<long>, times array<long>, {types}")


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two flags of a key in a bitmap of 2^bits."""
    return tuple(((key + np.uint64(1)) * m >> np.uint64(64 - bits)).astype(np.int64) for m in (_MIX[0], _MIX[3]))


def _flags(profile: DataFrame, least: int, most: int) -> tuple[np.ndarray, int]:
    """(bitmap, log2 of its flags) of the heavy shingles."""
    keys = profile.where("heavy IS NOT NULL").select(F.explode(F.arrays_zip("heavy", "times")).alias("x")).select("x.heavy", "x.times")
    while (count := keys.where(F.col("times") >= least).count()) > most // FLAGS_EACH and 2 * least <= HEAVIEST:
        least *= 2
    return _bitmap(keys.where(F.col("times") >= least).select("heavy"), count, most)


def _bitmap(keys: DataFrame, count: int, most: int) -> tuple[np.ndarray, int]:
    """(bitmap, log2 of its flags) of keys (long). Parts of it are made in tasks; `most` flags meet at the driver, and more keys only fill them up."""
    bits = max(16, min(FLAGS_EACH * count, most).bit_length() - 1) if count else 16
    flags, part = np.zeros(1 << bits - 3, np.uint8), 20  # a part is 2^20 flags
    if not count:
        return flags, bits
    out, back = pa.schema([("part", pa.int32()), ("places", pa.binary())]), pa.schema([("part", pa.int32()), ("flags", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.sort(np.concatenate(_places(b.column(0).to_numpy().astype(np.uint64), bits)))
            number, (places,) = _dealt((at >> part).astype(np.int32), (at & (1 << part) - 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(places, pa.binary())], schema=out)

    def mark(places: pa.Table) -> pa.Table:
        own = np.zeros(1 << min(part, bits), np.uint8)
        for x in places["places"]:
            own[np.frombuffer(x.as_buffer(), np.uint32)] = 1
        return pa.table([pa.array([places["part"][0].as_py()], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], schema=back)

    for r in keys.mapInArrow(place, "part int, places binary").groupBy("part").applyInArrow(mark, "part int, flags binary").collect():
        own = np.frombuffer(r["flags"], np.uint8)
        flags[r["part"] << part - 3 : (r["part"] << part - 3) + len(own)] = own
    return flags, bits


def _flagged(key: np.ndarray, flags: np.ndarray, bits: int) -> np.ndarray:
    return np.logical_and(*[(flags[x >> 3] >> (x & 7).astype(np.uint8)) & 1 for x in _places(key, bits)])


def _is_heavy(h: np.ndarray, flags: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    g = _mixed(h)
    return _flagged(_block(g, blocks).astype(np.uint64) << np.uint64(24) | _print(g), flags, bits)


def _index(texts: DataFrame, heavy: tuple[np.ndarray, int, int], blocks: int, salt: int, width: int) -> DataFrame:
    """Index entries in rows of column blocks (block, hashes, nodes, sizes), and the full sets of hot nodes with their numbers of rare shingles."""
    out = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("node", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("shingles", pa.binary())])
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start()
        seen: set[int] = set()
        h: list[np.ndarray] = []
        owner: list[int] = []
        sizes: list[int] = []
        total = 0

        def entries() -> pa.RecordBatch:
            count = [len(x) for x in h]
            hashes = _mixed(np.concatenate(h))
            order = np.argsort(hashes)
            hashes = hashes[order]
            # 32 bits tell a block's columns apart; two that share them add candidates, which are counted on full sets.
            number, columns = _dealt(_block(hashes, blocks), hashes.astype(np.uint32), np.repeat(np.array(owner, np.int64), count)[order], np.repeat(np.array(sizes, np.int32), count)[order])
            m = len(number)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *[pa.array(c, pa.binary()) for c in columns], *[pa.nulls(m, t) for t in out.types[4:]]], schema=out)

        for b in batches:
            hot: list[tuple[int, int, int, bytes]] = []
            for text in b.column(0):
                s = shingles(text.as_py(), width)
                if not len(s) or (name := node_of(s, salt)) in seen:
                    continue
                seen.add(name)
                p = indexed(len(s))
                rare = s[~_is_heavy(s, *sent.value)]
                if len(rare) < p:
                    hot.append((name, len(s), len(rare), s.tobytes()))
                if len(rare):
                    h.append(rare[:p])
                    owner.append(name)
                    sizes.append(len(s))
                    total += len(h[-1])
                    if total > FLUSH:
                        yield entries()
                        h, owner, sizes, total = [], [], [], 0
                        if len(seen) > MEMO:
                            seen.clear()
            if hot:
                m = len(hot)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] % blocks for x in hot], pa.int32()), *[pa.nulls(m, pa.binary())] * 3, *[pa.array(c, t) for c, t in zip(zip(*hot, strict=True), out.types[4:], strict=True)]], schema=out)
        if h:
            yield entries()

    return texts.select("text").mapInArrow(tidy(run), "block int, hashes binary, nodes binary, sizes binary, node long, n int, rare int, shingles binary")


PRODUCT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32()), ("n", pa.int32()), ("shared", pa.int32()), ("shingles", pa.binary())])


def _multiply(block: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap counts of the pairs of a column block, in any number of rows each; full sets pass through (a = b, shared: rare shingles)."""
    held: list[list[np.ndarray]] = [[], [], []]
    for b in block:
        full = b.filter(pa.compute.is_valid(b.column("node")))
        if full.num_rows:
            yield pa.RecordBatch.from_arrays([full.column(c) for c in ("node", "node", "n", "n", "rare", "shingles")], schema=PRODUCT)
        rows = b.filter(pa.compute.is_valid(b.column("hashes")))
        for own, c, t in zip(held, ("hashes", "nodes", "sizes"), (np.uint32, np.int64, np.int32), strict=True):
            own += [np.frombuffer(x.as_buffer(), t).copy() for x in rows.column(c)]
    if not held[0]:
        return
    h, node, n = map(np.concatenate, held)
    del held
    order = np.lexsort((node, h))
    h, node, n = h[order], node[order], n[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # tasks may have seen the same set
    h, node, n = h[new], node[new], n[new]
    names, first, number = np.unique(node, return_index=True, return_inverse=True)
    number = number.astype(np.int64)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        a, b = keys >> 32, keys & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b]), pa.array(n[first[a]]), pa.array(n[first[b]]), pa.array(counts.astype(np.int32)), pa.nulls(len(a), pa.binary())], schema=PRODUCT)

    # Entries of one column stand next to each other: step by step each meets all that follow it.
    found: list[np.ndarray] = []
    at, step, size = np.arange(len(h)), 0, 0
    while len(at):
        step += 1
        at = at[at + step < len(h)]
        at = at[h[at] == h[at + step]]
        m = n[at].astype(np.int64), n[at + step].astype(np.int64)
        ok = at[SIMILAR[1] * np.minimum(*m) >= SIMILAR[0] * np.maximum(*m)]
        found.append(number[ok] << 32 | number[ok + step])
        size += len(ok)
        if size > PAIRS:
            yield counted(found)
            found, size = [], 0
    if size:
        yield counted(found)


def _sets(texts: DataFrame, rows: DataFrame, nodes: DataFrame, salt: int, width: int) -> DataFrame:
    """node and shingles of the given nodes, and perhaps of some others, which are in nobody's pairs.

    A bitmap of the digests of one text of each tells which texts are cut again, where they are
    read: no text is shuffled.
    """
    out = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    one = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("digest").alias("digest"))
    own = materialize(one.join(nodes, "node", "left_semi").select("digest").distinct())
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(own, own.count(), FLAGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start()
        seen: set[int] = set()
        for b in batches:
            wanted = pa.array(_flagged(b.column(1).to_numpy().astype(np.uint64), *sent.value))
            got = []
            for text in b.column(0).filter(wanted):
                s = shingles(text.as_py(), width)
                if len(s) and (name := node_of(s, salt)) not in seen:
                    seen.add(name)
                    got.append((name, s.tobytes()))
            if len(seen) > MEMO:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], schema=out)

    # Texts of one set, and tasks that have seen the same text, give it more than once.
    made = materialize(texts.select("text", "digest").mapInArrow(tidy(run), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
    release(own)
    return made


def _verify(pairs: DataFrame, sets: DataFrame, bound: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok.append(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), *bound))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_())).cast(out)

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _by_column(chosen: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Names and sizes of the chosen sets, their columns, and by column the chosen rows that have it."""
    names = np.array([c[0] for c in chosen], np.int64)
    own = [np.frombuffer(c[1], np.uint64) for c in chosen]
    columns, number = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    order = np.argsort(number, kind="stable")
    return names, np.array([len(s) for s in own]), columns, row[order].astype(np.int32), np.searchsorted(number[order], np.arange(len(columns) + 1))


def _shared(blob: pa.Scalar, names: np.ndarray, sizes: np.ndarray, columns: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles a set shares with each of the chosen sets, and how many both have."""
    s = np.frombuffer(blob.as_buffer(), np.uint64)
    at = np.searchsorted(columns, s)
    at[at == len(columns)] = 0
    at = at[columns[at] == s]
    n = edges[at + 1] - edges[at]
    take = np.arange(n.sum()) + np.repeat(edges[at] - (np.cumsum(n) - n), n)
    shared = np.bincount(rows[take], minlength=len(names))
    return shared, len(s) + sizes - shared


def _to_pivots(hot: DataFrame, chosen: list[tuple[int, bytes]], bound: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links node, pivot of hot nodes and the chosen ones that they are similar to: a block product of incidence rows.

    What a task has already joined is one label, so a node gives a link for each label that it
    is similar to: the first of its pivots is always among them.
    """
    sent = hot.sparkSession.sparkContext.broadcast(_by_column(chosen))
    out = pa.schema([("node", pa.int64()), ("pivot", pa.int64())])
    num, den = bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value[0]
        label = np.arange(len(names))
        for b in batches:
            node, pivot = [], []
            for own, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shared, both = _shared(blob, *sent.value)
                near = np.flatnonzero(den * shared >= num * both)
                if len(near):
                    joined, first = np.unique(label[near], return_index=True)
                    if len(joined) > 1:
                        label[np.isin(label, joined)] = joined[0]
                    node += [own] * len(first)
                    pivot += names[near[first]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(pivot, pa.int64())], schema=out)

    return hot.select("node", "shingles").mapInArrow(tidy(run), "node long, pivot long")


def _near_pivots(nodes: DataFrame, chosen: list[tuple[int, bytes]], roots: list[int], bound: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those of the nodes (node, shingles, root) that something similar to chosen ones of another component may be similar to."""
    sent = nodes.sparkSession.sparkContext.broadcast((_by_column(chosen), np.array(roots, np.int64)))
    out = pa.schema([("node", pa.int64())])
    num, den = bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, root = sent.value
        for b in batches:
            near = []
            for blob, other in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                shared, both = _shared(blob, *block)
                near.append(bool(((den * shared >= (2 * num - den) * both) & (root != other)).any()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near, pa.bool_()))], schema=out)

    return nodes.select("node", "shingles", "root").mapInArrow(run, "node long")


def _counts_to(hot: DataFrame, chosen: list[tuple[int, bytes]], weights: list[int]) -> DataFrame:
    """node and links: the weights of the chosen nodes that each hot node is similar to, added up in its task."""
    sent = hot.sparkSession.sparkContext.broadcast((_by_column(chosen), np.array(weights, np.int64)))
    out = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = sent.value
        for b in batches:
            links = []
            for node, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shared, both = _shared(blob, *block)
                links.append(int(weight[(SIMILAR[1] * shared >= SIMILAR[0] * both) & (block[0] != node)].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(links, pa.int64())], schema=out)

    return hot.select("node", "shingles").mapInArrow(tidy(run), "node long, links long").where("links > 0")


def _some(rows: list, most: int = SENT) -> list:
    """Nodes of the first rows (node, bytes) that have `most` bytes together, one at least."""
    size = np.cumsum([r["bytes"] for r in rows])
    return [r["node"] for r, s in zip(rows, size.tolist(), strict=True) if s <= most] or [r["node"] for r in rows[:1]]


def _hot_counts(hot: DataFrame) -> DataFrame | None:
    """node and links, in parts to be added up, of hot nodes (node, shingles, size) among one another: every block of nodes against all."""
    found, last = None, -1  # names are not negative
    while picked := _some(hot.where(F.col("node") > last).select("node", F.octet_length("shingles").alias("bytes")).orderBy("node").limit(PIVOTS).collect(), SENT):
        chosen = hot.where(F.col("node").between(picked[0], picked[-1])).select("node", "shingles", "size").collect()
        part = materialize(_counts_to(hot, [(r["node"], bytes(r["shingles"])) for r in chosen], [r["size"] for r in chosen]))
        found, last = part if found is None else found.union(part), picked[-1]
    return found


def _hot_links(hot: DataFrame, bound: tuple[int, int] = SIMILAR) -> DataFrame | None:
    """Links a, b that connect all similar ones of the hot nodes (node, shingles, n, rare).

    Pivots are picked among nodes that no pivot is similar to yet, those with the fewest rare
    shingles first: they are in the middle of their groups. Blocks begin small, as a few pivots
    serve most of a large group. If the links leave more than one component, the nodes outside
    the largest that are near a pivot of another component are pivots as well: only they can be
    similar to nodes of other components.
    """
    spark = hot.sparkSession
    left, found, most, blocks = hot.select("node", F.octet_length("shingles").alias("bytes"), (F.col("rare") / F.col("n")).alias("share")), None, 64, []

    def sets(picked: list[int]) -> list[tuple[int, bytes]]:
        names = F.broadcast(spark.createDataFrame([(x,) for x in picked], "node long"))
        return [(r["node"], bytes(r["shingles"])) for r in hot.select("node", "shingles").join(names, "node", "left_semi").collect()]

    while picked := _some(left.orderBy("share", F.xxhash64("node"), "node").limit(most).select("node", "bytes").collect(), SENT):
        blocks.append(picked)
        part = materialize(_to_pivots(hot, sets(picked), bound))
        found, most, before = part if found is None else found.union(part), min(PIVOTS, 4 * most), left
        # A pivot is similar to itself, so it goes as well.
        left = materialize(left.join(part.select("node").distinct(), "node", "left_anti"))
        if found is not part:
            release(before)
    if found is None:
        return None
    links = found.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    roots = components(links)
    rooted = hot.select("node", "shingles").join(roots, "node", "left").select("node", "shingles", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "root").limit(2).collect()
    if len(groups) < 2:
        return links
    # Of two similar nodes in different components one is outside the largest, and near the other's pivot.
    rooted, near = materialize(rooted), None
    outside = rooted.where(F.col("root") != groups[0]["root"])
    for picked in blocks:
        names = F.broadcast(spark.createDataFrame([(x,) for x in picked], "node long"))
        chosen = rooted.join(names, "node", "left_semi").collect()
        part = _near_pivots(outside, [(r["node"], bytes(r["shingles"])) for r in chosen], [r["root"] for r in chosen], bound)
        near = part if near is None else near.union(part)
    near = materialize(near.distinct().join(hot.select("node", F.octet_length("shingles").alias("bytes")), "node"))
    last = -1  # names are not negative
    while picked := _some(near.where(F.col("node") > last).orderBy("node").limit(PIVOTS).collect(), SENT):
        part = materialize(_to_pivots(hot, sets(picked), bound))
        links, last = links.union(part.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), picked[-1]
    release(rooted, near)
    return links


def _candidates(product: DataFrame) -> DataFrame:
    """Pairs a, b of the product that share enough of their indexed parts to be similar."""
    num, den = SIMILAR
    out = lambda c: F.ceil(F.lit(num) * F.col(c) / F.lit(den)) - 1  # noqa: E731  shingles of n that aren't indexed
    need = F.ceil(F.lit(num) * (F.col("m") + F.col("n")) / F.lit(den + num)) - F.greatest(out("m"), out("n"))
    pairs = product.where("a <> b").groupBy("a", "b").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.sum("shared").alias("shared"))
    return pairs.where(F.col("shared") >= need).select("a", "b", "shared")


def _pair_links(texts: DataFrame, rows: DataFrame, product: DataFrame, salt: int, width: int) -> DataFrame:
    """Links among the pairs of the product; pairs that other links connect are left uncounted."""
    pairs = materialize(_candidates(product))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(texts, rows, nodes, salt, width)
    ends = pairs.select("a", "b", "shared").union(pairs.select("b", "a", "shared"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    links = materialize(_verify(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))
    roots = components(links)
    left = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    left = left.where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    return links.union(materialize(_verify(left.select("a", "b"), sets)))


def _multiplied(texts: DataFrame, width: int, heavy: int, flags: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, digest, n, node) of the texts, the product's pairs and hot sets, and the salt of the nodes' names."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # About six bytes make a word; blocks of the count and of the product hold as many entries.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = max(tasks, math.ceil(size / 24 / block))
    for salt in range(0, 100, 2):
        profile = materialize(_profile(texts, salt, width, heavy, cuts))
        lists = profile.where("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "digests", "n", "nodes", "guards")).alias("x"))
        rows = lists.select(F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"), "x.n", F.col("x.nodes").alias("node"), F.col("x.guards").alias("guard"))
        # Different sets under one name (none expected below 10^9 sets): take other names.
        if rows.where("node IS NOT NULL").groupBy("node").agg(F.min("guard").alias("x"), F.max("guard").alias("y"), F.min("n").alias("u"), F.max("n").alias("v")).where("x <> y OR u <> v").isEmpty():
            break
        release(profile)
    total = rows.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    index = _index(texts, (*_flags(profile, heavy, flags), cuts), max(tasks, math.ceil(total / block)), salt, width)
    product = materialize(index.groupBy("block").applyInArrow(_multiply, "a long, b long, m int, n int, shared int, shingles binary"))
    return rows.drop("guard"), product, salt


def _hot(product: DataFrame) -> DataFrame:
    """node, shingles, n and rare of the hot nodes; several tasks may have seen one."""
    return product.where("a = b").groupBy(F.col("a").alias("node")).agg(F.first("shingles").alias("shingles"), F.first("n").alias("n"), F.first("shared").alias("rare"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, heavy: int, flags: int, block: int) -> DataFrame:
    """id, digest, n and root (the same for rows that links connect; null without words) of each row."""
    texts = _texts(docs, id_col, text_col)
    rows, product, salt = _multiplied(texts, width, heavy, flags, block)
    hot = materialize(_hot(product))
    links, more = _pair_links(texts, rows, product, salt, width), _hot_links(hot)
    roots = components(links if more is None else links.union(more))
    release(hot, product)
    some = rows.where("node IS NOT NULL").join(roots, "node", "left").select("id", "digest", "n", F.coalesce("root", "node").alias("root"))
    return some.union(rows.where("node IS NULL").select("id", "digest", "n", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, heavy: int = HEAVY, flags: int = FLAGS, block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles and component_id (smallest id that links reach) of each row.

    Rows link when the Jaccard similarity of their sets of `width` word shingles is 0.75 or
    more. A text of fewer words is one shingle; null texts and texts without words have none
    and link with nothing, so their component is their own id. Rows of the same id and null
    ids keep a row each; a null id never names a component others with an id belong to. Ids
    are of any type that has an order; other columns are ignored.
    """
    rows = _classes(docs, id_col, text_col, width, heavy, flags, block)
    # Written, so that the join is of two plain shuffles, which Spark can split where one class has very many rows.
    least = materialize(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")))
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    linked = rows.where("root IS NOT NULL").join(least, "root").select(*own, F.col("least").alias("component_id"))
    return linked.union(rows.where("root IS NULL").select(*own, F.col("id").alias("component_id")))


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, heavy: int = HEAVY, flags: int = FLAGS, block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles and n_links of each row: the number of other rows that it links with, as near_duplicates defines links.

    Every pair of similar nodes counts, also those that other links connect. Pairs with a node
    that isn't hot are verified on full sets; hot nodes count one another in dense blocks
    without emitting pairs. A node counts for as many rows as have its set.
    """
    texts = _texts(docs, id_col, text_col)
    rows, product, salt = _multiplied(texts, width, heavy, flags, block)
    sizes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("size")))
    hot = materialize(_hot(product).join(sizes, "node"))
    is_hot = lambda c: hot.select(F.col("node").alias(c), F.lit(True).alias(f"hot_{c}"))
    pairs = materialize(_candidates(product).join(is_hot("a"), "a", "left").join(is_hot("b"), "b", "left").where("hot_a IS NULL OR hot_b IS NULL").select("a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = materialize(_verify(pairs, _sets(texts, rows, nodes, salt, width)))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    counts = ends.join(sizes.select(F.col("node").alias("other"), F.col("size").alias("links")), "other").select("node", "links")
    among = _hot_counts(hot)
    counts = (counts if among is None else counts.union(among)).groupBy("node").agg(F.sum("links").alias("links"))
    known = materialize(sizes.join(counts, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    some = rows.where("node IS NOT NULL").join(known, "node").select(*own, F.col("links").cast("long").alias("n_links"))
    return some.union(rows.where("node IS NULL").select(*own, F.lit(0).cast("long").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, heavy: int = HEAVY, flags: int = FLAGS, block: int = BLOCK) -> DataFrame:
    """docs, all their columns, with one row of each class of near_duplicates, and all rows that link with nothing.

    The row of the smallest id stays (one without an id only if none has one), of equal ids
    that of the smallest digest of the text, and any one of rows equal in both. A text stays
    or goes by itself, whatever other rows of the same id do.
    """
    rows = materialize(_classes(docs, id_col, text_col, width, heavy, flags, block).where("root IS NOT NULL"))
    best = materialize(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best")))
    best = best.select("root", F.col("best.id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    gone = materialize(rows.join(best, "root").where(~(F.col("id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest")))).select("id", "digest").distinct())
    once = materialize(rows.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"))
    return without(docs, gone, once, id_col=id_col, text_col=text_col)
