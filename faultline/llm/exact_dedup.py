"""Exact deduplication by deterministic block naming.

The text without white space is cut into blocks of fixed size. Distinct blocks are sorted
and their place in that order is their integer name. Adjacent names of a document are then
paired, distinct pairs are sorted and named in turn, and so on until each document holds a
single name. Two documents that need the same number of levels have the same last name if
and only if their texts are equal: every level maps distinct inputs to distinct names, so
there is no fingerprint whose collision could merge different texts. A name is a rank in the
whole table's order, so it doesn't depend on how rows are dealt to tasks.

Level 0 sorts blocks by their 64-bit hash, blocks of one hash by their text, and moves the block
texts once. A block travels back to its document by a 64-bit hash;
the few hashes that more than one distinct block has (none are expected below 10^9 blocks,
some 70 at 10^11) are told apart by the rank of the block text among the blocks of that hash.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import materialize, release

from .rows import digest, without

#: What the normalised text leaves out: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _named(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with an integer name each: their place in the order of all of them.

    Sorted ranges are written; a place is that in its range and the keys of all ranges before,
    a table with a row for each range.
    """
    place = F.monotonically_increasing_id()  # the range, and above it the place in it
    ranges = materialize(df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, F.shiftright(place, 33).alias("range"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    ahead = ranges.groupBy("range").agg(F.count("*").alias("n"))
    ahead = ahead.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
    return ranges.join(F.broadcast(ahead), "range").select(*keys, (F.col("ahead") + F.col("place")).alias("name"))


def block_names(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 2048, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(profile, identity): a row for each input row, and its collision-free identity.

    profile: row, id, digest, n_chars, sha256 (binary), hashes. identity: row, level, name.
    `hash_bits` below 64 is for tests that want colliding block hashes.
    """
    text = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    text = text.select("id", "digest", F.length("t").alias("n_chars"), without_spaces(F.col("t")).cast("binary").alias("b"))

    def block_hash(block: Column) -> Column:
        h = F.xxhash64(block)
        return h if hash_bits >= 64 else F.pmod(h, F.lit(2**hash_bits))

    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.lit(block_bytes))).cast("int")
    starts = F.sequence(F.lit(0), n_blocks - 1)
    cut = F.transform(starts, lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))

    # Sort and name the distinct blocks; count the distinct texts that share a hash.
    blocks = text.select(F.explode(cut).alias("block")).select(block_hash(F.col("block")).alias("h"), "block")
    variants = materialize(blocks.distinct().groupBy("h").agg(F.count("*").alias("variants")))
    shared = [r.h for r in variants.where("variants > 1").select("h").collect()]  # birthday bound: see the module's text
    names = _named(variants.select("h", F.explode(F.sequence(F.lit(0), (F.col("variants") - 1).cast("int"))).alias("k")), "h", "k")

    hashes = F.transform(cut, block_hash)
    odd = F.transform(cut, lambda x: F.when(block_hash(x).isin(shared), x)) if shared else F.lit(None).cast("array<binary>")
    profile = materialize(
        text.select(
            F.monotonically_increasing_id().alias("row"), "id", "digest", "n_chars",
            F.unhex(F.sha2("b", 256)).alias("sha256"), hashes.alias("hashes"), odd.alias("odd"),
        )
    )

    at = profile.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"), "odd")
    if shared:
        ranks = blocks.where(F.col("h").isin(shared)).distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1)
        at = at.withColumn("block", F.element_at("odd", F.col("pos") + 1)).join(ranks, ["h", "block"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    else:
        at = at.withColumn("k", F.lit(0))
    # Written, as is each level below: two later steps read it, and the union of all levels stays a plan of plain scans.
    level = materialize(at.join(names, ["h", "k"]).select("row", "n", "pos", "name"))

    most = profile.agg(F.max(F.size("hashes"))).first()[0] or 1
    done, number = level.where("n = 1").select("row", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        number += 1
        pairs = materialize(
            level.where("n > 1").groupBy("row", "n", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        level = materialize(pairs.join(_named(pairs, "a", "b"), ["a", "b"]).select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name"))
        release(pairs)
        done = done.union(level.where("n = 1").select("row", F.lit(number), "name"))
        most = (most + 1) // 2
    return profile, done


def _groups(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, digest, n_chars, sha256, level, name), and of each identity the group's size and the row that stays."""
    profile, identity = block_names(docs, **options)
    rows = profile.select("row", "id", "digest", "n_chars", "sha256").join(identity, "row")
    order = F.struct(-F.col("n_chars"), F.col("id"), F.col("row"))
    # Written, so that the join back is of two plain shuffles, which Spark can split where one group has very many rows.
    return rows, materialize(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min_by(F.struct("row", "id", "digest"), order).alias("keep")))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048, hash_bits: int = 64) -> DataFrame:
    """One row for each input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without the characters of SPACES. Of equal texts
    the row with the most code points stays, then the one with the smallest id (null first),
    then any single one of rows that are the same in both. A null text counts as empty; all
    empty texts are one group. Other columns of docs are ignored, so their names can't clash.
    Ids are of any type that has an order. An empty table gives an empty result.
    """
    rows, groups = _groups(docs, text_col=text_col, id_col=id_col, block_bytes=block_bytes, hash_bits=hash_bits)
    return rows.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are told apart by id and text; of rows equal in both one stays at most."""
    rows, groups = _groups(docs, text_col=text_col, id_col=id_col, block_bytes=block_bytes)
    other = ~(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("digest") == F.col("keep.digest")))
    gone = materialize(rows.join(groups, ["level", "name"]).where(other).select("id", "digest").distinct())
    once = materialize(rows.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"))
    release(groups)
    return without(docs, gone, once, id_col=id_col, text_col=text_col)
