"""Byte-level BPE encoding and decoding with a prefix-sharing trie.

Encodings by merge rank have a useful property: the encoding of a prefix of a word ends in
exactly one token t such that t may follow the last token of the encoding of what is left
when t is cut off. So one last token for each prefix holds all encodings of all prefixes of a
word. Distinct words are visited in the depth-first order of their trie (sorted order); the
last tokens of the part that a word shares with the word before it are kept and only the rest
is computed. Whether token u may stand before token t is asked of the merge table alone: it
holds if no merge of higher priority than those within u and t crosses their border.

In a text, words are looked up by white-space separated pieces, as most pieces come again
and again. Pieces that a worker hasn't met yet go to the trie together, batch by batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers.pre_tokenizers import ByteLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_type
from .workers import claim

#: How byte-level BPE files cut a text into words (public pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces and what they give in a generation of what a worker remembers, about; it keeps two. Bounds its memory, not the results.
MEMO = 40 << 20
#: Bytes that an entry takes besides its strings, about.
ENTRY = 330
#: Answers of may_follow() that a worker remembers at most.
FITS = 500_000
#: Characters of texts that are cut into pieces at once.
CHARS = 500_000
#: Code points below it are of the same class in all releases of Unicode that the libraries use.
SETTLED = "\u0530"
#: ASCII characters that are neither letters nor digits nor white space.
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: A space that has white space on either side is no place to cut a text.
UNSAFE = re.compile(r"\s (?!\S)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        ids = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.id_of = {bytes(to_byte[c] for c in t): i for t, i in ids.items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(file["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            u, t, both = ids[a], ids[b], ids[a + b]
            self.merge[u, t] = (rank, both)
            self.parts.setdefault(both, (rank, u, t))
        self.longest = max(map(len, self.id_of))
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.fits: dict[int, bool] = {}

    def encode_by_merges(self, word: bytes) -> list[int]:
        """The plain definition: apply the merge of lowest rank, leftmost first, until none is left."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, u: int, t: int) -> bool:
        """True if the encoding of the bytes of u and t is u, t; with u = -1, that of t is t. Remembered."""
        key = u << 32 | t
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.encode_by_merges(self.bytes_of[t]) == [t] if u < 0 else self.may_follow(-1, t) and self._may_follow(u, t)
        return known

    def _may_follow(self, u: int, t: int) -> bool:
        # Undo the merges of both sides from the last to the first; at no time may the tokens
        # at the border have a merge that would have come before the one undone last.
        last, parts, merge = 1 << 62, self.parts, self.merge
        a, b = u, t
        while True:
            m = merge.get((a, b))
            if m is not None and m[0] < last:
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            # The later merge is undone first; of equal merges the right one came later.
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                last, a = pa_[0], pa_[2]
            else:
                last, b = pb[0] + 1, pb[1]

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Encode distinct words that come in sorted order: a depth-first walk over their trie."""
        id_of, fits, slow = self.id_of, self.fits, self.may_follow
        longest, before = self.longest, b""
        last: list[int] = [-1]  # last[k]: last token of the encoding of the first k bytes; none of no bytes
        size: list[int] = [0]  # and its length in bytes
        for word in words:
            share, n = 0, min(len(before), len(word))
            while share < n and before[share] == word[share]:
                share += 1
            del last[share + 1 :], size[share + 1 :]
            for end in range(share + 1, len(word) + 1):
                # Only one start can be right; most often the last token grows or a new one begins.
                grown = end - 1 - size[end - 1]
                for start in (grown, end - 1, *range(end - 2, grown, -1), *range(grown - 1, max(0, end - longest) - 1, -1)):
                    t = id_of.get(word[start:end])
                    if t is None:
                        continue
                    ok = fits.get(last[start] << 32 | t)
                    if ok or (ok is None and slow(last[start], t)):
                        last.append(t)
                        size.append(end - start)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            before = word
            yield word, ids


class Coder:
    """Encodes and decodes texts; remembers the pieces it has met.

    A text is cut at its spaces where that cuts no word: `head` holds pieces that begin a text,
    `rest` those that follow a space, written without it. Each knows the number of its ids,
    the ids joined by commas and the text that they decode to.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(WORDS).findall
        self.cutter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.digits = {i: str(i) for i in self.vocabulary.bytes_of}
        self.head: dict[str, tuple[int, str, str]] = {}
        self.rest: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.held = 0

    def _cut(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if text.isascii() or max(text) < SETTLED:
            return self.words(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]  # the library has the last word on what is a letter

    def _cut_piece(self, piece: str) -> list[str]:
        """Words of a piece with its space; most pieces are letters, or letters and one mark."""
        if piece.isascii() or (piece and max(piece) < SETTLED):
            if piece.isalpha():
                return [" " + piece]
            if piece[-1:] in MARKS and piece[:-1].isalpha():
                return [" " + piece[:-1], piece[-1]]
            return self.words(" " + piece)
        return self._cut(" " + piece)

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), ",".join([self.digits[i] for i in ids]), self.decode(ids)

    def learn(self, heads: set[str], rests: set[str]) -> None:
        """Makes pieces known: the distinct new words in them go through the trie at once."""
        head, rest, older = self.head, self.rest, self.older
        rest.update([(p, older[p]) for p in rests if p in older])
        cut = {p: self._cut_piece(p) for p in rests if p not in older}
        whole: dict[str, list] = {}
        for p in heads:
            parts = self.specials.split(p) if self.specials else [p]
            whole[p] = [w for k, part in enumerate(parts) for w in ([self.vocabulary.special[part]] if k % 2 else self._cut(part) if part else ())]
        # A word that begins with a space is known as a piece; the others as heads.
        words = {w for ws in (*cut.values(), *whole.values()) for w in ws if isinstance(w, str)}
        new = sorted([w.encode() for w in words if (w[1:] not in rest if w[0] == " " else w not in head)])
        for word, ids in self.vocabulary.encode_sorted(new):
            w = word.decode()
            if w[0] == " ":
                rest[w[1:]] = self._entry(ids)
            else:
                head[w] = self._entry(ids)

        def joined(ws: list) -> tuple[int, str, str]:
            got = [self._entry([w]) if not isinstance(w, str) else rest[w[1:]] if w[0] == " " else head[w] for w in ws]
            return sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got])

        rest.update([(p, joined(ws)) for p, ws in cut.items() if len(ws) > 1])
        head.update([(p, joined(ws)) for p, ws in whole.items()])
        self.held += 4 * (sum(map(len, rests)) + sum(map(len, heads))) + ENTRY * (len(rests) + len(heads) + len(words))

    def forget(self) -> None:
        if self.held > MEMO:
            self.older, self.rest, self.head, self.held = self.rest, {}, {}, 0
        if len(self.vocabulary.fits) > FITS:
            self.vocabulary.fits.clear()

    def batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, ids joined by commas, decoded text."""
        cut = [[x] if UNSAFE.search(x) or (self.specials and self.specials.search(x)) else x.split(" ") for x in texts]
        head, rest = self.head, self.rest
        self.learn({c[0] for c in cut if c[0] not in head}, {p for c in cut for p in c[1:] if p not in rest})
        for c in cut:
            first = head[c[0]]
            got = list(map(rest.__getitem__, c[1:]))
            if first[0]:
                got.insert(0, first)
            yield sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got])
        self.forget()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for each worker process that works at this operator."""
    claim("bpe", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def groups(lengths: list[int], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters each; a longer text stands alone."""
    start = size = 0
    for k, n in enumerate(lengths):
        if k > start and size + n > chars:
            yield start, k
            start, size = k, 0
        size += n
    if lengths:
        yield start, len(lengths)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and token_ids (array of int) for each row. Null and empty texts have no ids.

    Rows keep their number, repeated ids and null ids included; ids are of any type; other
    columns are ignored.
    """
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), ("token_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for i, j in groups([len(x) for x in texts]):
                got = [[int(x) for x in g[1].split(",")] if g[0] else [] for g in own.batch(texts[i:j])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(got, out.field(1).type)], schema=out)

    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {name}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and text for each row of ids; null ids give an empty text."""
    kind, name = id_type(tokens, id_col)
    out = pa.schema([("id", kind), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], schema=out)

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"id {name}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 for each row.

    A null text counts as empty: no ids, the digests of an empty string. Very long texts and
    words are encoded whole; the state is one token for each byte of the longest word.
    """
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(b: bytes) -> str:
        return hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            n, ids, text = [], [], []
            for i, j in groups(pc.utf8_length(b.column(1)).to_pylist(), CHARS):
                for count, joined, decoded in own.batch(b.column(1).slice(i, j - i).to_pylist()):
                    n.append(count)
                    ids.append(digest(joined.encode()))
                    text.append(digest(decoded.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=out)

    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {name}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
