"""Token ids in grammar-compressed shards (Re-Pair) with random access.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library, closed
with an end id and packed into shards of about `shard_ids` ids. A shard is compressed on its
own: the most frequent pairs of neighbouring symbols become nonterminals, round after round,
until no pair has `least_uses` uses any more or all `symbols` are used up. What a round has
made can be part of later pairs. Pairs never cross the border of a document.

A shard is one row of a Parquet table, so any store that Spark writes will do:
  part, seq        place of the shard: partition, number in it
  first            ids of the same partition before the shard
  n_ids            ids in the shard
  base             lowest nonterminal; ids below it stand for themselves
  width            bytes of a symbol, 2 or 4
  doc_ids          int64 of each document (doc_null marks rows whose id was null)
  doc_lengths      uint32, ids of each document with the end id
  doc_symbols      uint32, symbols of each document
  rules            pairs of symbols: what nonterminal base + k expands to, both below it
  rule_lengths     uint32, ids in the expansion of each nonterminal
  symbols          all documents one after the other
One document is decoded from its own symbols and the rules; a place within it is found by
adding up expansion lengths, without decoding what stands before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import shared_dir

from .bpe import groups
from .workers import claim

#: The least number of uses of a rule.
LEAST_USES = 4
#: Symbols of a shard, ids and nonterminals: as many as 16 bits have. With 2^31, or a vocabulary that fills 16 bits
#: by itself, symbols are 32 bits wide and only the least number of uses ends the replacement.
SYMBOLS = 1 << 16
#: Characters of texts whose distinct pieces are encoded together, and characters of pieces that go to the library as one text.
TOGETHER = 16_000_000
TEXT = 1 << 18
#: Bytes of distinct pieces and their ids that an encoder remembers from batch to batch, at most. What it remembers is looked up in each batch, so more would take longer than it saves.
REMEMBER = 24_000_000
#: White space as Python and Unicode have it. A space that has some on either side, or stands last, is no place to cut a text.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters that all releases of Unicode call so, and marks of ASCII.
LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
MARK = r"[!-/:-@\[-`{-~]"
#: Stands at the begin of a piece that follows no space; texts that have it themselves aren't cut.
GLUE = "\x01"
WHOLE = rf"{SPACE} (?:{SPACE}|$)|{GLUE}"
#: More places to cut: before marks that end a word, and before a line feed between a mark and a letter.
CUTS = ((rf"({LETTER})({MARK}+)( |\n|$)", rf"\1 {GLUE}\2\3"), (rf"({MARK})\n({LETTER})", f"\\1 {GLUE}\n\\2"))

SHARD = "part int, seq int, first long, n_ids long, base int, width int, doc_ids binary, doc_null binary, doc_lengths binary, doc_symbols binary, rules binary, rule_lengths binary, symbols binary"


class Encoder:
    """Ids by the tokenizers library; of many texts together every distinct piece is encoded once.

    Pieces and their ids are remembered up to REMEMBER bytes; beyond that only those of the last
    batch stay. Texts are cut at spaces, and at other places where byte-level BPE always cuts words. Distinct
    pieces are encoded many at a time, as one text: no token crosses a cut, so the bytes that
    tokens stand for say which ids belong to which piece. Arrow cuts texts, finds the distinct
    pieces and puts the ids of the texts together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        tokens = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | {i: len(t.content.encode()) for i, t in added.items()}
        self.size = max(tokens, default=-1) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes = np.zeros(self.size, np.int64)  # a byte-level vocabulary writes a character for each byte
        self.bytes[list(tokens)] = list(tokens.values())
        self.special = [t.content for t in added.values()]
        self.known, self.lists = pa.array([], pa.string()), _lists(np.empty(0, self.kind), np.empty(0, np.int64))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], self.kind), np.array([len(ids) for ids in got], np.int64)

    def _joined(self, pieces: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """As _each, for pieces of words that follow a space, or a line feed that isn't theirs, or begin with one."""
        ids, counts = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        size = pc.binary_length(pieces).to_numpy().astype(np.int64) + len(before)
        for i, j in groups(size.tolist(), TEXT):
            part = pieces[i:j]
            text = before + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), before)[0].as_py()
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.bytes[got]), np.cumsum(size[i:j])) + 1
            own = np.diff(ends, prepend=0)
            if before == "\n":  # the line feed is a token by itself
                stay = np.ones(len(got), bool)
                stay[ends - own] = False
                got, own = got[stay], own - 1
            ids.append(got)
            counts.append(own)
        return np.concatenate(ids), np.concatenate(counts)

    def _distinct(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each of the distinct pieces of texts but for the first ones."""
        glued = pc.starts_with(pieces, GLUE).to_numpy(zero_copy_only=False)
        bare = pc.utf8_slice_codeunits(pieces, 1).filter(pa.array(glued))
        begins = pc.match_substring_regex(pieces, rf"^(?:{SPACE}|$)").to_numpy(zero_copy_only=False)
        line = pc.starts_with(bare, "\n").to_numpy(zero_copy_only=False)
        kinds = [~glued & ~begins, ~glued & begins]
        made = [self._joined(pieces.filter(pa.array(kinds[0])), " "), self._each([" " + p for p in pieces.filter(pa.array(kinds[1])).to_pylist()])]
        for own, before in ((~line, "\n"), (line, "")):
            kinds.append(np.zeros(len(pieces), bool))
            kinds[-1][np.flatnonzero(glued)[own]] = True
            made.append(self._joined(bare.filter(pa.array(own)), before))
        # From the order by kind to that of the pieces.
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([np.flatnonzero(k) for k in kinds])] = np.arange(len(pieces))
        return _lists(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])).take(pa.array(order))

    def _looked_up(self, pieces: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """(lists of ids, which of them each of the distinct pieces has). Only pieces that aren't remembered are encoded."""
        at = pc.index_in(pieces, value_set=self.known.cast(pieces.type))
        fresh = pc.is_null(at)
        new = pieces.filter(fresh)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        lists = pa.concat_arrays([self.lists, self._distinct(new)]) if len(new) else self.lists
        self.known, self.lists = pa.concat_arrays([self.known.cast(pieces.type), new]), lists
        if self.known.nbytes + self.lists.nbytes > REMEMBER:
            own = lists.take(pa.array(place))
            few = pieces.nbytes + own.nbytes <= REMEMBER
            self.known, self.lists = (pieces, own) if few else (pieces[:0], lists[:0])
        return lists, place

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, 16 bits wide or 32."""
        whole = pc.match_substring_regex(texts, WHOLE)
        for t in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        whole = whole.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        ids, counts = self._each(texts.filter(pa.array(whole)).to_pylist())
        self._deal(out, np.flatnonzero(whole), ids, counts)
        safe = texts.filter(pa.array(~whole))
        if not len(safe):
            return out
        for pattern, to in CUTS:
            safe = pc.replace_substring_regex(safe, pattern, to)
        cut = pc.split_pattern(safe, " ")
        parts, first = cut.flatten(), cut.offsets.to_numpy()
        first = first[:-1] - first[0]
        follows = np.ones(len(parts), bool)
        follows[first] = False
        heads, pieces = (parts.filter(pa.array(x)).dictionary_encode() for x in (~follows, follows))
        # All distinct parts, heads last, are lists of ids; each text is a run of them.
        lists, place = self._looked_up(pieces.dictionary)
        known = pa.concat_arrays([lists, _lists(*self._each(heads.dictionary.to_pylist()))])
        number = np.empty(len(parts), np.int64)
        number[follows], number[first] = place[pieces.indices.to_numpy()], heads.indices.to_numpy() + len(lists)
        counts = np.add.reduceat(np.diff(known.offsets.to_numpy())[number], first)
        self._deal(out, np.flatnonzero(~whole), known.take(pa.array(number)).flatten().to_numpy(), counts)
        return out

    @staticmethod
    def _deal(out: list[bytes], places: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Puts the ids of successive texts to their places."""
        raw, ends = ids.tobytes(), (ids.itemsize * np.cumsum(counts)).tolist()
        for k, x, y in zip(places.tolist(), [0, *ends], ends, strict=False):
            out[k] = raw[x:y]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, symbols: int = SYMBOLS, least_uses: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules as pairs). lengths: ids of each document.

    A round takes the pairs of at least `bar` uses, most frequent first; the bar falls from
    round to round. Where chosen pairs overlap the more frequent one is replaced, so the most
    frequent of all always is and the rounds come to an end. Once the bar is at its lowest,
    rounds look where the one before has changed or passed over something; before the end one
    looks at all places again.
    """
    end = np.uint32(1 << 31)  # marks the last symbol of a document
    seq = ids.astype(np.uint32)
    seq[np.cumsum(lengths)[lengths > 0] - 1] |= end
    rules: list[np.ndarray] = []
    made, bar, fresh = 0, 0, None
    while len(seq) > 1 and base + made < symbols:
        slots = 16 if not bar or bar > 500 else 20  # pairs are counted by hash first; few slots do while only very frequent ones are wanted
        left, right = (seq[:-1], seq[1:] & ~end) if fresh is None else (seq[fresh], seq[fresh + 1] & ~end)
        wide, place_bits = max(16, (base + made - 1).bit_length()), len(seq).bit_length()
        if wide == 16:
            key = left << np.uint32(16) | right
            slot = (key * np.uint32(_GOLDEN >> np.uint64(32)) >> np.uint32(32 - slots)).astype(np.intp)
        else:
            key = left.astype(np.uint64) << np.uint64(wide) | right
            slot = (key * _GOLDEN >> np.uint64(64 - slots)).astype(np.intp)
        slot[np.flatnonzero(left >= end)] = 1 << slots
        # Of a run of one symbol only every second pair counts: the others overlap.
        twin = np.flatnonzero(left == right)
        if len(twin):
            place = twin if fresh is None else fresh[twin]
            first = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))
            slot[twin[(np.arange(len(twin)) - np.repeat(first, np.diff(np.append(first, len(twin))))) & 1 == 1]] = 1 << slots
        count = np.bincount(slot, minlength=(1 << slots) + 1)
        count[1 << slots] = 0
        top = int(count.max())  # of a slot, so no pair has more
        bar = max(least_uses, min(bar, top) // 4 if bar else top // 32)
        place = np.flatnonzero((count >= bar)[slot])
        own = key[place].astype(np.uint64)
        if fresh is not None:
            place = fresh[place]
        if 2 * wide + place_bits <= 64:
            both = np.sort(own << np.uint64(place_bits) | place.astype(np.uint64))
            own, place = both >> np.uint64(place_bits), (both & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        else:
            order = np.argsort(own, kind="stable")
            own, place = own[order], place[order]
        start = np.flatnonzero(own[1:] != own[:-1]) + 1
        start = np.concatenate([np.zeros(min(1, len(own)), np.int64), start])
        uses = np.diff(np.append(start, len(own)))
        often = np.flatnonzero(uses >= bar)
        if not len(often):
            if bar == least_uses and fresh is None:
                break
            fresh = None
            continue
        # Most frequent first, of equal ones the smaller pair.
        often = often[np.argsort(-uses[often], kind="stable")][: symbols - base - made]
        none = len(often)
        rank = np.full(len(uses), none, np.int32)
        rank[often] = np.arange(none)
        rank = np.repeat(rank, uses)
        hit = place = place[rank < none]
        rank = rank[rank < none]
        at = np.full(len(seq) + 1, none, np.int32)  # rank of the pair that begins at a place; the last one is free, also as place -1
        at[place] = rank
        won = (rank < at[place - 1]) & (rank < at[place + 1])
        place, rank = place[won], rank[won]
        worth = np.bincount(rank, minlength=none) >= least_uses
        some = worth[rank]
        place, rank = place[some], rank[some]
        pairs = own[start[often]][worth]
        rules.append(np.stack([pairs >> np.uint64(wide), pairs & np.uint64((1 << wide) - 1)], axis=1))
        seq[place] = (base + made + np.cumsum(worth)[rank] - 1).astype(np.uint32) | seq[place + 1] & end
        made += len(pairs)
        stay = np.ones(len(seq), dtype=bool)
        stay[place + 1] = False
        fresh = None
        if bar == least_uses:
            moved = np.cumsum(stay, dtype=np.int32 if len(seq) < 1 << 31 else np.int64) - 1
        seq = seq[stay]
        if bar == least_uses:
            look = np.zeros(len(seq) + 1, bool)  # the last one is free, as place -1
            for at in (moved[place], moved[place] - 1, moved[hit[stay[hit]]]):
                look[at] = True
            fresh = np.flatnonzero(look[: len(seq) - 1])
    ends = np.flatnonzero(seq >= end) + 1
    sizes = np.zeros(len(lengths), dtype=np.uint32)
    sizes[lengths > 0] = np.diff(np.concatenate([[0], ends]))
    kind = "<u2" if base + made <= 1 << 16 else "<u4"
    return (seq & ~end).astype(kind), sizes, (np.concatenate(rules) if rules else np.empty((0, 2))).astype(kind)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = [1] * base
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[base:], dtype=np.uint32)


def expansions(rules: np.ndarray, base: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pool, start of each symbol in it): ids stand for themselves, nonterminals for their whole expansion.

    Rules of one depth expand at once, from what lies below them.
    """
    n = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    starts = np.cumsum(n) - n
    pool = np.empty(int(n.sum()), dtype=np.uint32)
    pool[:base] = np.arange(base)
    depth = [0] * base
    for a, b in rules.tolist():
        depth.append(1 + max(depth[a], depth[b]))
    depths = np.array(depth[base:], np.int64)
    for d in range(1, int(depths.max(initial=0)) + 1):
        own = np.flatnonzero(depths == d)
        a, b = rules[own, 0].astype(np.int64), rules[own, 1].astype(np.int64)
        for part, at in ((a, starts[base + own]), (b, starts[base + own] + n[a])):
            size = n[part]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pool[np.repeat(at, size) + within] = pool[np.repeat(starts[part], size) + within]
    return pool, starts


def expand(symbols: np.ndarray, pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    sym = symbols.astype(np.int64)
    n = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])[sym]
    ends = np.cumsum(n)
    if not len(ends):
        return np.empty(0, np.uint32)
    return pool[np.arange(ends[-1]) + np.repeat(starts[sym] - (ends - n), n)]


_ENCODERS: dict[str, Encoder] = {}


def write_token_shards(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1_000_000, symbols: int = SYMBOLS, least_uses: int = LEAST_USES) -> None:
    """Writes the shards of docs, in ascending order of ids (whole numbers), to the folder `path`.

    A null text counts as empty: it has the end id alone. Rows with a null id come first;
    rows of equal ids are ordered by text. A document is never split between shards, however
    long it is. An empty table writes no shard. With `symbols` of 2^31 pairs are replaced
    until none has `least_uses` uses.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("base", pa.int32()), ("width", pa.int32()), *[(n, pa.binary()) for n in ("doc_ids", "doc_null", "doc_lengths", "doc_symbols", "rules", "rule_lengths", "symbols")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_shards", _ENCODERS.clear)
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
        own = _ENCODERS[tokenizer_path]
        base, end, part, wide = max(own.size, end_id + 1), np.array([end_id], own.kind).tobytes(), TaskContext.get().partitionId(), own.kind.itemsize
        room = symbols if base < symbols else 1 << 31
        ids: list = []
        held: list[bytes] = []
        size = seq = first = 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // wide for x in held], dtype="<u4")
            coded, sizes, rules = compress(np.frombuffer(b"".join(held), own.kind), lengths, base, room, least_uses)
            row = [part, seq, first, int(lengths.sum()), base, coded.itemsize, np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids], np.uint8).tobytes(), lengths.tobytes(), sizes.astype("<u4").tobytes(), rules.tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), coded.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in groups(pc.utf8_length(texts).to_pylist(), TOGETHER):
                for name, code in zip(names[i:j], own.batch(texts[i:j]), strict=True):
                    ids.append(name)
                    held.append(code + end)
                    size += len(code) // wide + 1
                    if size >= shard_ids:
                        yield shard()
                        first, seq, size, ids, held = first + size, seq + 1, 0, [], []
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text").mapInArrow(run, SHARD).write.parquet(path)


def _shards(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Shards with `before`: ids of all shards before each of them. Partitions are as few as write tasks, so their sums fit anywhere."""
    shards = spark.read.schema(SHARD).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return shards.join(F.broadcast(parts), "part").select((F.col("ahead") + F.col("first")).alias("before"), "base", "width", "doc_ids", "doc_null", "doc_lengths", "doc_symbols", "rules", "rule_lengths", "symbols")


def _documents(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids of documents, their lengths, all token ids) of a shard."""
    base, kind = row["base"], f"<u{row['width']}"
    rules, lengths = np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")
    pool, starts = expansions(rules, base, lengths)
    tokens = expand(np.frombuffer(row["symbols"], kind), pool, starts, lengths, base)
    names = [None if null else i for i, null in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["doc_null"], strict=True)]
    return names, np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64), tokens


def read_token_shards(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before it), token_ids (with the end id) of each document."""
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("token_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                names, n, tokens = _documents(row)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(row["before"] + ends - n, pa.int64()), lists], schema=out)

    return _shards(spark, path).mapInArrow(run, "id long, start long, token_ids array<int>").withColumnRenamed("id", id_col)


def token_slice(row: dict, document: int, start: int, stop: int) -> list[int]:
    """Ids start to stop of one document of a shard: rules whose expansions lie outside are skipped by their lengths."""
    base, kind = row["base"], f"<u{row['width']}"
    rules, lengths = np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")
    sizes = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    at = int(sizes[:document].sum())
    out: list[int] = []
    here = 0
    stack = np.frombuffer(row["symbols"], kind)[at : at + int(sizes[document])][::-1].tolist()
    while stack and here < stop:
        s = stack.pop()
        n = 1 if s < base else int(lengths[s - base])
        if here + n <= start:
            here += n
        elif s < base:
            out.append(s)
            here += 1
        else:
            stack += [int(rules[s - base][1]), int(rules[s - base][0])]
    return out


def shard_digests(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), read from the shards."""
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                names, n, tokens = _documents(row)
                ends = np.cumsum(n)
                view = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(row["before"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=out)

    return _shards(spark, path).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_shards(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the shards of docs to a new shared folder and returns their digests, read back."""
    path = shared_dir(docs.sparkSession)
    write_token_shards(docs, tokenizer_path, path, **options)
    return shard_digests(docs.sparkSession, path, id_col=options.get("id_col", "doc_id"))
