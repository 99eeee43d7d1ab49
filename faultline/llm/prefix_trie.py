"""A prefix trie of conversations: level-order unary degree sequences (LOUDS) by prefix shard.

A conversation is a path of turns. A turn's label is a digest of its role and text; a prefix is
named by sums of its labels mixed with their places, 128 bits wide, so names come from running
sums and a prefix's parent from its own sum less its last label. Texts are read and sorted once
(they settle the order of equal turns) and go no further than that.

Nodes are prefixes, aggregated from the paths' rows. Those that many conversations share are the
heavy upper levels; there are fewer than UPPER of them at any size of input, and they are merged
in one trie of their own, at last. What hangs below them falls into subtrees, which are dealt
into shards of bounded size, in bands of DEPTH turns where conversations are very long. Each shard
becomes a forest in level order: a bit vector with a one for each child and a zero for each end of
a node's children, and an array of labels. Its rollups go from the last level to the first, adding
up at parents, which rank on the bits gives. What the top of a subtree has gathered is added to
the node that it hangs below, in the band above or in the upper levels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import running
from faultline.sources.scratch import materialize, release

from .workers import claim

#: Ids of a family share the turns of their first one; the number of shared turns is below SHARES.
FAMILY, SHARES = 5, 9
#: Heavy nodes are fewer than UPPER, and none has LEAST conversations or fewer.
UPPER, LEAST = 1 << 20, 1000
#: Turns of a band, and nodes of a shard, about.
DEPTH, SHARD = 1024, 200_000


class Louds:
    """A forest in level order: node 0 is a root above all tops; bits and labels say the rest."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray) -> None:
        """bits: for each node from 0 on as many ones as it has children, then a zero. labels: of nodes 1 and on, those of one parent ascending."""
        self.bits, self.labels = bits, labels
        zeros = np.cumsum(bits == 0)
        ones = np.flatnonzero(bits)
        #: The parent of each node: as many zeros as stand before its one.
        self.parent = np.concatenate([[-1], zeros[ones]])
        ends = np.flatnonzero(bits == 0)
        self.degree = np.diff(np.concatenate([[-1], ends])) - 1
        self.first = np.concatenate([[1], 1 + np.cumsum(self.degree)[:-1]])
        self.levels = [0, 1]
        while self.levels[-1] < len(self.parent):  # a level's children stand together, right behind it
            self.levels.append(int(np.searchsorted(self.parent, self.levels[-1])))

    @classmethod
    def of(cls, names: np.ndarray, parents: np.ndarray) -> tuple[Louds, np.ndarray]:
        """(forest, places of nodes 1 and on among the given): distinct names, and the names of their parents; who has none here is a top."""
        order = np.argsort(names)
        known = names[order]
        at = np.minimum(np.searchsorted(known, parents[order]), max(0, len(known) - 1))
        up = np.where(known[at] == parents[order], at, -1) if len(known) else at
        down = np.argsort(up, kind="stable")  # children by parent, then by name
        start = np.searchsorted(up[down], np.arange(-1, len(known) + 1))
        level, found, degrees = np.array([-1]), [], []
        while len(level):
            n = start[level + 2] - start[level + 1]
            degrees.append(n)
            level = down[np.repeat(start[level + 1] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            found.append(level)
        degree, nodes = np.concatenate(degrees), np.concatenate(found)
        bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        return cls(bits, known[nodes]), order[nodes]

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, from the last level to the first."""
        total = values.copy()
        for low, high in zip(self.levels[-2:0:-1], self.levels[:0:-1], strict=False):
            np.add.at(total, self.parent[low:high], total[low:high])
        return total

    def child(self, node: int, label: bytes) -> int | None:
        """The child of a node by its label."""
        low, high = int(self.first[node]), int(self.first[node] + self.degree[node])
        at = low + int(np.searchsorted(self.labels[low - 1 : high - 1], label))
        return at if at < high and self.labels[at - 1] == label else None


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


ROOT = hashlib.md5(b"0,0,0,0,0").digest()


def placed_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), a digest in two parts and the bytes of the text of each turn, in the order of turn (null first), role and text."""
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    label = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(","), F.col("role"), F.col("text")), 256))
    turns = turns.withColumns({"__label": label}).select("*", F.xxhash64(F.lit(1), "__label").alias("one"), F.xxhash64(F.lit(2), "__label").alias("two"), F.octet_length("text").cast("long").alias("bytes")).drop("__label")
    return running(turns, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], position="place", by=["conv_id"], keep=["conv_id", "one", "two", "bytes"])


def families(sizes: DataFrame) -> DataFrame:
    """conv_id, base (the family's first id), h (turns to take from it), taken (turns that it has of these) and length (turns of the conversation as rebuilt)."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARES))
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    got = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    return got.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def rebuilt(turns: DataFrame, family: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), one, two, bytes and length: the first h turns of the family's first conversation, then the own ones after h."""
    own = turns.join(family, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "one", "two", "bytes", "length")
    first = turns.where(F.col("place") < SHARES - 1).withColumnRenamed("conv_id", "base")
    return own.union(family.join(first, "base").where("place < h").select("conv_id", F.col("place") + 1, "one", "two", "bytes", "length"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name and parent (16 bytes), bytes and whether it is the last of its conversation, of each row of conv_id, depth, one, two, bytes, length."""
    salted = [F.xxhash64("depth", c) for c in ("one", "two")]
    lanes = {f"l{k}": (F.shiftrightunsigned(salted[k // 2], 32) if k % 2 else salted[k // 2].bitwiseAND(0xFFFFFFFF)) for k in range(4)}  # sums of 32 bits don't overflow
    summed = running(turns.withColumns(lanes), [F.col("depth")], {f"s{k}": F.col(f"l{k}") for k in range(4)}, None, ["conv_id"])
    before = [F.col(f"s{k}") - F.col(f"l{k}") for k in range(4)]
    return summed.select("conv_id", "depth", _name(F.col("depth"), [F.col(f"s{k}") for k in range(4)]).alias("name"), _name(F.col("depth") - 1, before).alias("parent"), "bytes", (F.col("depth") == F.col("length")).alias("last"))


def _fixed(column: pa.Array) -> np.ndarray:
    """Binary values of 16 bytes; an array of such strings compares as they do."""
    return np.array(column.to_pylist(), "S16")


NODE = "name binary, parent binary, conv_id long, depth long, n_convs long, bytes long, more_children long, more_leaves long, more_saved long"
NUMBERS = ("conv_id", "depth", "n_convs", "bytes", "more_children", "more_leaves", "more_saved")
TRIE = pa.schema([("shard", pa.int64()), ("louds", pa.binary()), ("size", pa.int64()), ("labels", pa.binary()), ("parents", pa.list_(pa.binary())), *[(c, pa.list_(pa.int64())) for c in NUMBERS]])
TRIE_TYPES = ", ".join(["shard long, louds binary, size long, labels binary, parents array<binary>", *[f"{c} array<long>" for c in NUMBERS]])


def build_tries(nodes: DataFrame) -> DataFrame:
    """A row for each shard of nodes (NODE and shard): packed bits, their number, labels, the parents of tops, and the nodes' numbers, in level order."""

    def build(table: pa.Table) -> pa.Table:
        claim("trie")
        names = _fixed(table["name"])
        forest, at = Louds.of(names, _fixed(table["parent"]))
        tops = table["parent"].take(pa.array(at[: forest.degree[0]]))
        lists = [pa.array([np.array(table[c])[at]], pa.list_(pa.int64())) for c in NUMBERS]
        # Strings of numpy lose zeros at their end, so labels are taken from the table.
        labels = b"".join(table["name"].take(pa.array(at)).to_pylist())
        first = [table["shard"][0].as_py()], [np.packbits(forest.bits).tobytes()], [len(forest.bits)], [labels], [tops.to_pylist()]
        return pa.table([*[pa.array(v, t) for v, t in zip(first, TRIE.types, strict=False)], *lists], schema=TRIE)

    return nodes.groupBy("shard").applyInArrow(build, TRIE_TYPES)


ROLLED = pa.schema([("name", pa.binary()), ("above", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]])


def trie_nodes(tries: DataFrame) -> DataFrame:
    """A row for each node of the tries: name, above (the parent of a top), conv_id, depth, parent_conv_id (null for tops), n_convs, n_children, n_leaves, saved_tokens."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        for b in batches:
            for k in range(b.num_rows):
                labels, size = b.column("labels")[k].as_py(), b.column("size")[k].as_py()
                forest = Louds(np.unpackbits(np.frombuffer(b.column("louds")[k].as_py(), np.uint8), count=size), np.frombuffer(labels, "S16"))
                x = {c: np.concatenate([[0], np.array(b.column(c)[k].values)]) for c in NUMBERS}  # node 0 is nobody's
                children = forest.degree + x["more_children"]
                leaves = forest.rolled_up((children == 0) + x["more_leaves"])
                saved = forest.rolled_up((x["n_convs"] - 1) * x["bytes"] + x["more_saved"])
                tops = int(forest.degree[0])
                above = pa.concat_arrays([pa.array(b.column("parents")[k].as_py(), pa.binary()), pa.nulls(len(children) - 1 - tops, pa.binary())])
                parent = pa.array(x["conv_id"][forest.parent[1:]], mask=forest.parent[1:] == 0)
                names = pa.array([labels[i : i + 16] for i in range(0, len(labels), 16)], pa.binary())
                numbers = [pa.array(v[1:]) for v in (x["conv_id"], x["depth"])] + [parent] + [pa.array(v[1:]) for v in (x["n_convs"], children, leaves, saved)]
                yield pa.RecordBatch.from_arrays([names, above, *numbers], schema=ROLLED)

    return tries.mapInArrow(roll, "name binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def ends_digests(ends: DataFrame) -> DataFrame:
    """name and ends_sha256: the ids (conv_id, ascending, comma-joined) of the conversations that end at a node.

    A digest has an order, so a node's ids go through one task; they come sorted and are never held.
    """
    out = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            names, shas = [], []
            node = _fixed(b.column(0))
            edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)] if len(node) else [0]
            ids = b.column(1).cast(pa.string()).to_pylist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                name, text = b.column(0)[i].as_py(), ",".join(ids[i:j]).encode()
                if name == now:
                    state.update(b"," + text)
                    continue
                if now is not None:
                    names.append(now)
                    shas.append(state.hexdigest())
                now, state = name, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(shas, pa.string())], schema=out)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], schema=out)

    return ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(run, "name binary, ends_sha256 string")


def _rolled(nodes: DataFrame, below: DataFrame | None, shard: Column) -> DataFrame:
    """trie_nodes of nodes (name, parent, conv_id, depth, n_convs, bytes) with what hangs below them (above, children, leaves, saved)."""
    more = {f"more_{c}": F.coalesce(F.col(c), F.lit(0)) for c in ("children", "leaves", "saved")} if below is not None else {f"more_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    if below is not None:
        sums = below.groupBy("above").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
        nodes = nodes.join(sums, nodes["name"] == sums["above"], "left").drop("above")
    tries = materialize(build_tries(nodes.select("name", "parent", "conv_id", "depth", "n_convs", "bytes", *[c.alias(k) for k, c in more.items()], shard.alias("shard"))))
    return trie_nodes(tries)


def prefix_trie(rows: DataFrame, *, upper: int = UPPER, least: int = LEAST, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, from the root of depth 0 on.

    rows: conv_id, turn, role, text; other columns aren't read. conv_id is the node's smallest
    member, parent_conv_id its parent's; n_convs counts members, n_children and n_leaves children
    and childless nodes below (or itself), saved_tokens sums (n_convs - 1) * bytes of the last text
    over the subtree; ends_sha256 is of the ids that end here. Null roles and texts are empty.
    Turns go by turn (null first), of equals by role, then by text; equal rows are so many turns.
    Rows without a conv_id belong to no conversation. The first id of a family is conv_id less
    its remainder by 5, which has the id's sign. An empty table gives no rows. Conversations and
    texts of any length are taken; of a text only its bytes count here.
    """
    turns = materialize(placed_turns(rows))
    sizes = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    family = materialize(families(sizes))
    path = materialize(paths(rebuilt(turns, family)))
    release(turns)
    convs = family.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    heavy_from = max(least, path.count() // upper)  # so heavy nodes are fewer than `upper`: their rows add up to those of the paths
    heavy = materialize(path.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > heavy_from).select(F.col("name").alias("heavy")))
    banded = path.join(F.broadcast(heavy), F.col("name") == F.col("heavy"), "left").withColumn("band", F.floor((F.col("depth") - 1) / depth))
    # A conversation's first node in a band that isn't heavy is the top of the subtree that holds the rest of it.
    tops = materialize(banded.where("heavy IS NULL").groupBy("conv_id", "band").agg(F.min_by("name", "depth").alias("top")))
    joined = banded.join(tops.withColumnsRenamed({"conv_id": "__c", "band": "__b"}), (F.col("conv_id") == F.col("__c")) & (F.col("band") == F.col("__b")), "left")
    nodes = joined.groupBy("name").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("band").alias("band"), F.first(F.when(F.col("heavy").isNull(), F.col("top"))).alias("top"))
    nodes = materialize(nodes)
    release(tops)
    light = nodes.where("top IS NOT NULL")
    done, below = None, None
    bands = {r["band"]: r["n"] for r in light.groupBy("band").agg(F.count("*").alias("n")).collect()}  # as many as the longest conversation has bands
    for band in sorted(bands, reverse=True):
        of = F.pmod(F.xxhash64("top"), F.lit(math.ceil(bands[band] / shard)))
        got = materialize(_rolled(light.where(F.col("band") == band), below, of))
        hung = got.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        done, below = (got, hung) if done is None else (done.union(got), below.union(hung))
    zero = convs.where("n_convs > 0").select(F.lit(ROOT).alias("name"), F.lit(b"").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    high = zero.union(nodes.where("top IS NULL").select("name", "parent", "conv_id", "depth", "n_convs", "bytes"))
    up = _rolled(high, below, F.lit(0).cast("long"))
    done = up if done is None else done.union(up)
    # Tops know their parents by name: nodes of the upper levels, and last nodes of bands.
    known = zero.select("name", "conv_id").union(nodes.where((F.col("top").isNull()) | (F.col("depth") % depth == 0)).select("name", "conv_id"))
    known = known.select(F.col("name").alias("above"), F.col("conv_id").alias("above_conv_id"))
    ends = path.where("last").select("name", "conv_id").union(family.where("length = 0").select(F.lit(ROOT), "conv_id"))
    got = done.join(known, "above", "left").join(ends_digests(ends), "name", "left")
    return got.select("conv_id", "depth", F.coalesce("parent_conv_id", "above_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
