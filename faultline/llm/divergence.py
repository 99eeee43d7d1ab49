"""How the sources of a language differ in their words: an exact divergence audit.

A byte table says which bytes of the concatenated UTF-8 buffers belong to terms; boundaries are
where that changes or a document begins. xxhash groups equal slices, and their bytes are compared,
so a shared hash merges nothing. Counts go by language and block of terms to the tasks that keep
the terms of enough documents.

What is kept becomes, in blocks of terms, sparse matrices of sources by terms (CSR). Terms that a
source lacks all have its base probability, so the distance of two sources over a block is that
of their bases and of what either has, added up over CSR rows with reduceat. Blocks hand on a sum
for each pair of sources and the first terms of each source. All numbers are whole: a probability
is 1 + floor(10^9 (count + 5) / (N + 5 V)), found by long division.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import materialize

from .workers import claim

#: A language keeps the terms that so many of its documents have.
LEAST_DOCS = 30
#: What is added to each count, and what a probability of one is, less 1.
ADDED = 5
ONE = 1_000_000_000
#: Terms of a source that are listed.
LISTED = 50
#: Bytes of text that are cut into terms at once; a longer text goes in pieces of about that.
CHUNK = 4 << 20
#: Counts that a task holds before it merges them, or hands them on.
HELD = 1 << 20
#: Counts of a block of the matrices, about.
BLOCK = 1 << 16

#: Bytes of terms: ASCII letters, and all of what isn't ASCII. A-Z become a-z.
IS_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def slices(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in a buffer of documents that begin and end at the edges."""
    inside = IS_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    cut[[0, -1]] = True
    start = inside & cut[:-1]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & cut[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group of each slice, a slice of each group): equal bytes and no others are one group.

    Slices are grouped by hash, and compared byte by byte with the first of their hash; those
    that differ are told apart by their bytes. `bits` below 64 is for tests that want shared hashes.
    """
    raw = data.tobytes()
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    if bits < 64:
        h &= np.uint64((1 << bits) - 1)
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    size, like = ends - starts, first[group]
    same = size == size[like]
    own = np.flatnonzero(same)
    count, begin = size[own], np.concatenate([[0], np.cumsum(size[own])])
    at = np.repeat(starts[own] - begin[:-1], count) + np.arange(begin[-1])
    equal = data[at] == data[at + np.repeat(starts[like[own]] - starts[own], count)]
    if len(own):
        same[own] = np.logical_and.reduceat(equal, begin[:-1])
    if not same.all():  # slices of other bytes under a hash
        more: dict[bytes, int] = {}
        firsts = []
        for k in np.flatnonzero(~same).tolist():
            name = raw[starts[k] : ends[k]]
            if name not in more:
                more[name] = len(first) + len(firsts)
                firsts.append(k)
            group[k] = more[name]
        first = np.concatenate([first, firsts])
    return group, first


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[start], np.add.reduceat(n[order], start) if len(start) else np.empty(0, np.int64)


class Counts:
    """Occurrences of terms in sources, and the number of documents that have them; added up when many are held."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.sources: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, terms: list[bytes], docs: np.ndarray, sources: list[bytes], term: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """docs: of each term. term, source, n: places in the lists and the number of occurrences."""
        names = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in terms), np.int64, len(terms))
        own = np.fromiter((self.sources.setdefault(s, len(self.sources)) for s in sources), np.int64, len(sources))
        self.held.append((names[term] << 32 | own[source], n.astype(np.int64)))
        self.docs.append((names, docs.astype(np.int64)))
        self.size += len(n)
        if self.size > HELD and len(self.held) > 1:
            self.held, self.docs = [self._sums(self.held)], [self._sums(self.docs)]
            self.size = len(self.held[0][0]) // 2  # so that merging stays in proportion to what comes

    @staticmethod
    def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def __len__(self) -> int:
        return len(self.terms)

    def result(self) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """terms, their documents, sources, and the counts by term: term, source, n."""
        key, n = self._sums(self.held)
        _, docs = self._sums(self.docs)
        return list(self.terms), docs, list(self.sources), key >> 32, key & 0xFFFFFFFF, n


def _pieces(data: np.ndarray, edges: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """first and last document, first and last byte of stretches of about `most` bytes: whole documents, or a piece of one that ends beside a term."""
    doc, n = 0, len(edges) - 1
    while doc < n:
        last = max(doc + 1, int(np.searchsorted(edges, edges[doc] + most, "right")) - 1)
        a, b = int(edges[doc]), int(edges[last])
        while b - a > most and last == doc + 1:
            cut = a + most
            while cut < b and IS_TERM[data[cut]]:
                cut += 1
            yield doc, last, a, cut
            a = cut
        yield doc, last, a, b
        doc = last


def _counted(batch: pa.RecordBatch, totals: dict[bytes, Counts], chunk: int, bits: int = 64) -> Iterator[None]:
    """Adds the terms of a batch of lang, source, text (binary) to the counts of their languages; yields after each stretch."""
    text = batch.column(2)  # without nulls
    if not len(text):
        return
    edges = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    begin, edges = int(edges[0]), edges - edges[0]
    sizes = np.diff(edges)
    data = LOWER[np.frombuffer(text.buffers()[2], np.uint8)[begin : begin + edges[-1]]] if edges[-1] else np.empty(0, np.uint8)
    langs, lang = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
    sources, source = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
    names, seen, before = sources.tolist(), set(), -1
    for first, last, a, b in _pieces(data, edges, chunk):
        own = data[a:b]
        starts, ends = slices(own, np.clip(edges[first : last + 1] - a, 0, b - a))
        if not len(starts):
            yield
            continue
        group, one = grouped(own, starts, ends, bits)
        doc = np.searchsorted(edges[first : last + 1] - a, starts, "right") - 1 + first
        raw = own.tobytes()
        terms = [raw[starts[k] : ends[k]] for k in one.tolist()]
        pairs, n = _summed(group.astype(np.int64) * len(sizes) + doc, np.ones(len(doc), np.int64))
        term, doc = pairs // len(sizes), pairs % len(sizes)
        new = np.ones(len(term), np.int64)  # a document that goes in pieces counts once for each of its terms
        if first != before:
            seen = set()
        if b - a < edges[last] - edges[first]:
            for k, t in enumerate(term.tolist()):
                if terms[t] in seen:
                    new[k] = 0
                seen.add(terms[t])
        before = first
        for k in np.unique(lang[doc]).tolist():
            some = lang[doc] == k
            used, place = np.unique(term[some], return_inverse=True)
            key, count = _summed(place.astype(np.int64) * len(names) + source[doc[some]], n[some])
            there, at = np.unique(key % len(names), return_inverse=True)
            totals.setdefault(langs[k], Counts()).add([terms[t] for t in used.tolist()], np.bincount(place, new[some]).astype(np.int64), [names[s] for s in there.tolist()], key // len(names), at, count)
        yield


PACKED = pa.schema([("lang", pa.binary()), ("block", pa.int32()), ("terms", pa.binary()), ("docs", pa.binary()), ("sources", pa.list_(pa.binary())), ("term", pa.binary()), ("source", pa.binary()), ("n", pa.binary())])
KEPT = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("sources", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def _packed(lang: bytes, counts: Counts, blocks: int) -> pa.RecordBatch:
    """A row for each block of terms (by hash). No term holds a space, so spaces join them."""
    terms, docs, sources, term, source, n = counts.result()
    block = np.fromiter((xxhash.xxh3_64_intdigest(t, seed=1) for t in terms), np.uint64, len(terms))
    block = ((block >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entry = np.argsort(rank[term], kind="stable")
    at, source, n = rank[term][entry], source[entry].astype(np.int32), n[entry]
    start = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
    ends = [*start[1:].tolist(), len(order)]
    rows: list[list] = [[] for _ in PACKED]
    for a, b in zip(start.tolist(), ends, strict=True):
        i, j = np.searchsorted(at, [a, b])
        used, own = np.unique(source[i:j], return_inverse=True)
        values = lang, int(block[order[a]]), b" ".join(terms[k] for k in order[a:b].tolist()), docs[order[a:b]].tobytes(), [sources[k] for k in used.tolist()], (at[i:j] - a).astype(np.int32).tobytes(), own.astype(np.int32).tobytes(), n[i:j].tobytes()
        for column, v in zip(rows, values, strict=True):
            column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PACKED.types, strict=True)], schema=PACKED)


def kept_terms(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """lang, term (binary), sources, counts: each term that `least` or more documents of a language have, with its occurrences in each source that has it.

    The number of blocks grows with the square root of the text, as vocabularies do at most.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * math.isqrt(size >> 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("divergence")
        totals: dict[bytes, Counts] = {}
        for b in batches:
            for _ in _counted(b, totals, chunk, bits):
                if sum(map(len, totals.values())) > HELD // 2 or sum(c.size for c in totals.values()) > 2 * HELD:
                    for lang, c in totals.items():
                        yield _packed(lang, c, blocks)
                    totals.clear()
        for lang, c in totals.items():
            yield _packed(lang, c, blocks)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lang = Counts(), b""
        for b in batches:
            lang = b.column("lang")[0].as_py()
            for r in b.to_pylist():
                term, source = (np.frombuffer(r[c], np.int32) for c in ("term", "source"))
                counts.add(r["terms"].split(b" "), np.frombuffer(r["docs"], np.int64), r["sources"], term, source, np.frombuffer(r["n"], np.int64))
        terms, docs, sources, term, source, n = counts.result()
        often = docs >= least
        some = often[term]
        term, source, n = term[some], source[some], n[some]
        chosen = np.flatnonzero(often)
        ends = np.searchsorted(term, chosen, "right")
        names = pa.array(sources, pa.binary())
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, names.take(pa.array(source))), pa.ListArray.from_arrays(offsets, pa.array(n))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chosen), pa.binary()), pa.array([terms[k] for k in chosen.tolist()], pa.binary()), *lists], schema=KEPT)

    packed = named.mapInArrow(count, "lang binary, block int, terms binary, docs binary, sources array<binary>, term binary, source binary, n binary")
    return packed.groupBy("lang", "block").applyInArrow(merge, "lang binary, term binary, sources array<binary>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), by three digits at a time: nothing exceeds 63 bits while totals stay below 9 * 10^15."""
    rest, out = count + ADDED, np.zeros(len(count), np.int64)
    out += rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def block_divergence(lengths: np.ndarray, source: np.ndarray, n: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Of a block: p of its counts, p - q of these, and for each source its distances from those after it.

    lengths: counts of each term, 1 at least. source, n: of each count. totals: N + 5 V of each source.
    """
    terms = np.repeat(np.arange(len(lengths)), lengths)
    p = share(n, totals[source])
    base = share(np.zeros(len(totals), np.int64), totals)
    start = np.cumsum(lengths) - lengths
    # N + 5 V of the language: each source's total holds 5 V of its own.
    order = np.lexsort((terms, source))
    row, col, val = source[order], terms[order], p[order]
    edges = np.searchsorted(row, np.arange(len(totals) + 1))

    def distances() -> Iterator[np.ndarray]:
        count = len(lengths)
        for g in range(len(totals) - 1):
            own = slice(edges[g], edges[g + 1])
            dense = np.full(count, base[g])
            dense[col[own]] = val[own]
            # First as if the others had no term here: distances of all values of g from their bases.
            have = np.sort(val[own])
            below = np.concatenate([[0], np.cumsum(have)])
            b = base[g + 1 :]
            k = np.searchsorted(have, b)
            sums = (count - len(have)) * np.abs(base[g] - b) + b * k - below[k] + (below[-1] - below[k]) - b * (len(have) - k)
            rest = slice(edges[g + 1], len(row))
            if rest.start < rest.stop:
                x = dense[col[rest]]
                gain = np.abs(x - val[rest]) - np.abs(x - base[row[rest]])
                there = np.flatnonzero(edges[g + 2 :] > edges[g + 1 : -1])  # reduceat wants rows that aren't empty
                sums[there] += np.add.reduceat(gain, edges[g + 1 : -1][there] - rest.start)
            yield sums

    return p, np.add.reduceat(n, start) if len(lengths) else np.empty(0, np.int64), distances()


def _parts(kept: DataFrame, groups: DataFrame, listed: int) -> DataFrame:
    """lang, source, part, item, value: sums of blocks for pairs (source before item), and the first terms of each source in each block."""
    back = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own: dict[bytes, tuple[int, int]] = {}
        lang = b""
        for b in batches:
            lang = b.column("lang")[0].as_py()
            for s, n, v in zip(*[b.filter(b.column("source").is_valid()).column(c).to_pylist() for c in ("source", "n", "v")], strict=True):
                own[s] = n, v
            held.append(b.filter(b.column("term").is_valid()))
        names = sorted(own)
        place = {s: k for k, s in enumerate(names)}
        totals = np.array([own[s][0] + ADDED * own[s][1] for s in names], np.int64)
        size = own[names[0]][1] if names else 0
        whole = sum(own[s][0] for s in names) + ADDED * size
        table = pa.Table.from_batches(held).sort_by("term") if held else None
        terms = table["term"].to_pylist() if table else []
        lists = table["sources"].combine_chunks() if table else None
        lengths = np.array(lists.value_lengths(), np.int64) if terms else np.empty(0, np.int64)
        source = np.fromiter((place[s] for s in lists.flatten().to_pylist()), np.int64) if terms else np.empty(0, np.int64)
        n = np.array(table["counts"].combine_chunks().flatten(), np.int64) if terms else np.empty(0, np.int64)
        p, all_n, distances = block_divergence(lengths, source, n, totals)
        for g, sums in enumerate(distances):
            m = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.binary()), pa.array([names[g]] * m, pa.binary()), pa.array(["pair"] * m), pa.array(names[g + 1 :], pa.binary()), pa.array(sums)], schema=back)
        if not terms:
            return
        term = np.repeat(np.arange(len(lengths)), lengths)
        gap = p - share(all_n, whole)[term]
        some = np.flatnonzero((gap > 0) & (n > 0))
        some = some[np.lexsort((term[some], -gap[some], source[some]))]
        first = np.searchsorted(source[some], source[some])
        some = some[np.arange(len(some)) - first < listed]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.binary()), pa.array([names[k] for k in source[some].tolist()], pa.binary()), pa.array(["term"] * len(some), pa.string()), pa.array([terms[k] for k in term[some].tolist()], pa.binary()), pa.array(gap[some])], schema=back)

    rows = kept.select("lang", "block", "term", "sources", "counts", F.lit(None).cast("binary").alias("source"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
    each = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = rows.unionByName(each.select("lang", "block", "source", "n", "v"), allowMissingColumns=True)
    return both.groupBy("lang", "block").applyInArrow(run, "lang binary, source binary, part string, item binary, value long")


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, listed: int = LISTED, chunk: int = CHUNK, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and its most outstanding terms.

    Part `pair` has a row for each other source of the language (value: the sum of |p - q| over
    all kept terms, 0 without any), part `term` the first `listed` kept terms that the source
    has and that are likelier there than in the language. Ranks go by value, then by the bytes
    of the item. Null languages, sources and texts are empty strings. Repeated rows count each
    for itself, ids and other columns aren't read. A source without terms is compared all the
    same; an empty table gives no rows. A text of any length goes in pieces.
    """
    kept = materialize(kept_terms(docs, lang_col=lang_col, source_col=source_col, text_col=text_col, least=least, chunk=chunk, bits=bits))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.size("sources")).alias("counts"))
    groups = docs.select(*named).distinct()
    wide = groups.groupBy("lang").agg(F.count("*").alias("wide"))
    # A language's blocks hold its counts and a row for each of its sources: more sources make larger blocks, not more rows.
    langs = wide.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.greatest(F.lit(1), F.ceil(F.coalesce("counts", F.lit(0)) / F.greatest(F.lit(block), F.col("wide")))).alias("blocks"))
    langs = materialize(langs)
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "blocks")
    dealt = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    parts = _parts(dealt, known, listed)
    pair = F.col("part") == "pair"
    both = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block
    both = both.withColumn("x", F.explode(F.when(pair, F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))))
    ranked = both.select("lang", "x.source", "part", "x.item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where(pair | (F.col("rank") <= listed)).select(F.col("lang").cast("string"), F.col("source").cast("string"), "part", F.col("item").cast("string"), "value", "rank")
