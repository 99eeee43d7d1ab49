"""Benchmark decontamination with a distributed positional inverted index.

Training texts are indexed in shards of whole documents. A shard holds the sorted list of its
terms and, for each, the ascending positions at which it stands in the shard's documents laid
end to end; documents are a step of `GAP` apart, so no phrase can span two of them. Shards are
rows of a table, built where the documents are read and searched where they lie: neither
building nor searching shuffles.

A test phrase is found by intersecting position lists, each moved back by the term's place in
the phrase, from the shard's rarest term to the most frequent one; phrases of which any term
is missing in a shard end before the first intersection. Queries reach the shards as a
broadcast of at most `QUERY_WORDS` words; more queries are searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.sources.scratch import materialize, release

from .rows import digest, without
from .workers import claim, tidy

#: Consecutive item words that make a window.
WINDOW = 10
#: Words of a shard, about; a longer document makes a shard of its own.
SHARD_WORDS = 200_000
#: Words of queries that are broadcast at once (about 50 MB in a worker).
QUERY_WORDS = 500_000
#: Positions between two documents of a shard, so that phrases and proximity stay within one.
GAP = 1 << 10
#: A-Z to a-z; every other ASCII character that is no digit or letter to a space. Bytes from 0x80 on belong to words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COLUMNS = ("n_words", "terms", "offsets", "positions")


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def words(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index, a row for each shard: number, ids and digests of its documents, and binary COLUMNS.

    Every row of docs is in one shard, null and empty texts with no words. Ids are of any type.
    """
    kind = docs.select(id_col).schema[0].dataType
    out = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("digests", pa.list_(pa.int64())), *[(c, pa.binary()) for c in COLUMNS]])

    def shard(name: int, ids: list, digests: list[int], counts: list[int], tokens: list[bytes]) -> pa.RecordBatch:
        number = _Numbers()
        codes = np.fromiter(map(number.__getitem__, tokens), np.uint32, len(tokens))
        terms = sorted(number)
        rank = np.empty(len(terms), np.uint32)
        rank[np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms), dtype=np.uint32)
        codes = rank[codes] if len(terms) else codes
        n = np.array(counts, np.int64)
        place = np.arange(len(tokens)) + np.repeat(np.arange(len(n)) * GAP, n)
        order = np.argsort(codes, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))])
        row = [n.astype("<i8"), b"\n".join(terms), offsets.astype("<i8"), place[order].astype("<i8" if len(place) and place[-1] >= 1 << 31 else "<i4")]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], out.types[1]), pa.array([digests], out.types[2]), *[pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in row]], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        name = TaskContext.get().partitionId() << 33
        ids: list = []
        digests: list[int] = []
        counts: list[int] = []
        tokens: list[bytes] = []
        for b in batches:
            for i, d, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1), strict=True):
                got = words(text.as_py())
                if ids and len(tokens) + len(got) > shard_words:
                    yield shard(name, ids, digests, counts, tokens)
                    name, ids, digests, counts, tokens = name + 1, [], [], [], []
                ids.append(i)
                digests.append(d)
                counts.append(len(got))
                tokens += got
        if ids:
            yield shard(name, ids, digests, counts, tokens)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), digest(F.col(text_col)).alias("digest"))
    return texts.mapInArrow(tidy(run), f"shard long, doc_ids array<{kind.simpleString()}>, digests array<long>, {', '.join(c + ' binary' for c in COLUMNS)}")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One shard after the other: a batch holds as many as Arrow's bound on bytes allows."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


class Shard:
    """A shard of the index in a worker's memory."""

    def __init__(self, row: dict):
        self.ids, self.digests = row["doc_ids"], row["digests"]
        self.n_words = np.frombuffer(row["n_words"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.starts = np.cumsum(self.n_words) - self.n_words + np.arange(len(self.ids)) * GAP
        terms = row["terms"].split(b"\n") if len(self.offsets) > 1 else []
        self.number = dict(zip(terms, range(len(terms)), strict=True))
        wide = len(row["positions"]) == 8 * int(self.offsets[-1])
        self.positions = np.frombuffer(row["positions"], "<i8" if wide and self.offsets[-1] else "<i4")

    def codes(self, vocabulary: list[bytes]) -> np.ndarray:
        """The shard's number of each word, -1 if it doesn't occur."""
        return np.fromiter((self.number.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))

    def list_of(self, code: int) -> np.ndarray:
        return self.positions[self.offsets[code] : self.offsets[code + 1]]

    def phrase(self, codes: np.ndarray) -> np.ndarray:
        """Positions at which the phrase begins: offset-adjusted lists, from the rarest term on."""
        size = self.offsets[codes + 1] - self.offsets[codes]
        found = None
        for k in np.argsort(size, kind="stable"):
            if found is None:
                found = self.list_of(codes[k]).astype(np.int64) - k
                found = found[found >= 0]
                continue
            other, want = self.list_of(codes[k]), found + k
            at = np.searchsorted(other, want)
            at[at == len(other)] = 0
            found = found[other[at] == want]
            if not len(found):
                break
        return found

    def near(self, codes: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term with all other terms within `span` words on either side."""
        size = self.offsets[codes + 1] - self.offsets[codes]
        order = np.argsort(size, kind="stable")
        found = self.list_of(codes[order[0]]).astype(np.int64)
        for k in order[1:]:
            other = self.list_of(codes[k])
            after = np.searchsorted(other, found)
            right = np.where(after < len(other), other[np.minimum(after, len(other) - 1)] - found, span + 1)
            left = np.where(after > 0, found - other[np.maximum(after - 1, 0)], span + 1)
            found = found[np.minimum(left, right) <= span]
            if not len(found):
                break
        return found

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _windows(items: list[tuple[int | None, list[bytes]]], width: int) -> tuple[list[bytes], dict[int, tuple[np.ndarray, list[set]]]]:
    """(vocabulary, by length: (rows of word numbers, the items of each row)). Equal windows are one row."""
    number: dict[bytes, int] = {}
    by: dict[int, dict[tuple[int, ...], set]] = {}
    for item, ws in items:
        code = [number.setdefault(w, len(number)) for w in ws]
        n = min(width, len(code))
        for k in range(len(code) - n + 1) if n else ():
            by.setdefault(n, {}).setdefault(tuple(code[k : k + n]), set()).add(item)
    return list(number), {n: (np.array(list(rows), np.int64), list(rows.values())) for n, rows in by.items()}


def _query_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of at most `most` words (or one item), streamed to the driver partition by partition."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        ws = words(row[1])
        if block and size + len(ws) > most:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    yield block


def find_windows(index: DataFrame, items: DataFrame, *, width: int = WINDOW, item_id: str = "item_id", item_text: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """Exact phrase matches, a row for each document and block of queries with a match:
    id, digest (of the text), n_words, items (ids with a window in it) and hits (ascending word places that a window covers)."""
    spark = index.sparkSession
    kinds = index.schema["doc_ids"].dataType.elementType, items.select(item_id).schema[0].dataType
    out = pa.schema([("row", pa.string()), ("id", to_arrow_type(kinds[0])), ("digest", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(to_arrow_type(kinds[1]))), ("hits", pa.list_(pa.int32()))])
    result = None
    for number, block in enumerate(_query_blocks(items, item_id, item_text, query_words)):
        sent = spark.sparkContext.broadcast(_windows(block, width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, whole=number == 0) -> Iterator[pa.RecordBatch]:
            claim("decontaminate")
            vocabulary, by = sent.value
            for row in _rows(batches):
                shard = Shard(row)
                codes = shard.codes(vocabulary)
                hits: dict[int, list[np.ndarray]] = {}
                found: dict[int, set] = {}
                for n, (rows, owners) in by.items():
                    there = codes[rows]
                    for k in np.flatnonzero((there >= 0).all(axis=1)):
                        at = shard.phrase(there[k])
                        doc = shard.document(at)
                        for d in np.unique(doc).tolist():
                            hits.setdefault(d, []).append((at[doc == d] - shard.starts[d])[:, None] + np.arange(n))
                            found.setdefault(d, set()).update(owners[k])
                docs = range(len(shard.ids)) if whole else sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{row['shard']}:{d}" for d in docs], pa.string()), pa.array([shard.ids[d] for d in docs], out.types[1]), pa.array([shard.digests[d] for d in docs], pa.int64()), pa.array([int(shard.n_words[d]) for d in docs], pa.int64()),
                        pa.array([sorted(found.get(d, ()), key=str) for d in docs], out.types[4]), pa.array([np.unique(np.concatenate([h.ravel() for h in hits[d]])) if d in hits else [] for d in docs], pa.list_(pa.int32())),
                    ], schema=out)

        part = index.mapInArrow(tidy(run), f"row string, id {kinds[0].simpleString()}, digest long, n_words long, items array<{kinds[1].simpleString()}>, hits array<int>")
        result = part if result is None else result.unionByName(part)
    if number:  # several blocks: put together what each has found in a document
        result = result.groupBy("row").agg(F.first("id").alias("id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    return result.drop("row")


def find_near(index: DataFrame, queries: list[str], span: int) -> DataFrame:
    """Proximity matches: query, doc_id and place (of the query's rarest term in the shard) where all its terms stand within `span` words of it."""
    if span >= GAP:
        raise ValueError(f"a span is below {GAP} words")
    kind = index.schema["doc_ids"].dataType.elementType
    out = pa.schema([("query", pa.string()), ("doc_id", to_arrow_type(kind)), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        for row in _rows(batches):
            shard = Shard(row)
            for q in queries:
                codes = shard.codes(sorted(set(words(q))))
                if len(codes) and (codes >= 0).all():
                    at = shard.near(codes, span)
                    doc = shard.document(at)
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(at), pa.string()), pa.array([shard.ids[d] for d in doc], out.types[1]), pa.array(at - shard.starts[doc], pa.int64())], schema=out)

    return index.mapInArrow(run, f"query string, doc_id {kind.simpleString()}, place long")


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    Items of fewer than `width` words are one window, those without words none. Null texts have
    no words. An item id that several rows share counts once; a null item id is left out of
    items_sha256 and n_items but its windows count as hits. No items: nothing is hit. Ids of
    either table are of any type; other columns are ignored.
    """
    index = materialize(build_index(docs, id_col=id_col, text_col=text_col, shard_words=shard_words))
    found = find_windows(index, items, width=width, item_id=item_id, item_text=item_text, query_words=query_words)
    names = F.array_sort(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """The rows of docs without any hit, with all their columns. A text goes by itself, whatever other rows of its id hold."""
    index = materialize(build_index(docs, id_col=id_col, text_col=text_col, shard_words=shard_words))
    found = find_windows(index, items, width=width, item_id=item_id, item_text=item_text, query_words=query_words)
    gone = materialize(found.where(F.size("hits") > 0).select("id", "digest").distinct())
    release(index)
    return without(docs, gone, id_col=id_col, text_col=text_col)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """An index written with `build_index(...).write.parquet(path)`."""
    return spark.read.parquet(path)
