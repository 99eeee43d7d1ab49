"""Token counts of documents under a unigram vocabulary, by dynamic programming on a trie.

Distinct white-space separated words (pre-tokens, each with the mark of a word's begin) are
visited in the depth-first order of their trie. The forward scores - the best log probability
of each prefix and the number of tokens of that best segmentation - of a shared prefix are
computed once; a word's terminal count is what stands at its last character. A document's
count is the sum over its words. Workers remember terminal counts from batch to batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .rows import id_type
from .workers import claim

MARK = "▁"
#: Scores below the lowest of the vocabulary that a character without a token of its own gets.
UNKNOWN_PENALTY = 10.0
#: Bytes of words in a generation of what a worker remembers, about; it keeps two. Bounds its memory, not the results.
MEMO = 100 << 20
#: Bytes that an entry takes besides its characters, about.
ENTRY = 150


def piece_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file, most frequent first, with log probabilities by Zipf's law.

    The public file lists pieces by the rank of their merge and has no probabilities; a model
    of this kind trained elsewhere can be given to `Counter` instead. Control pieces and
    single-byte pieces are left out: bytes are what unknown characters fall back to. Counts
    under it tell how long documents are and serve to plan budgets and mixtures; they aren't
    the lengths of a certain model's ids.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (k + 3) for k in range(len(pieces))))
    return {p: -math.log(k + 3) - norm for k, p in enumerate(pieces)}


class Counter:
    """Counts tokens of words; an unknown character counts as its UTF-8 bytes."""

    def __init__(self, vocabulary: dict[str, float]):
        self.score = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0

    def terminal_counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Token counts of distinct words in sorted order, sharing the forward scores of common prefixes."""
        get, longest, unknown = self.score.get, self.longest, self.unknown
        before, best, count = "", [0.0], [0]
        for word in words:
            text = MARK + word
            share, n = 0, min(len(before), len(text))
            while share < n and before[share] == text[share]:
                share += 1
            del best[share + 1 :], count[share + 1 :]
            for end in range(share + 1, len(text) + 1):
                top, tokens = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    s = get(text[start:end])
                    if s is not None and best[start] + s > top:
                        top, tokens = best[start] + s, count[start] + 1
                if get(text[end - 1]) is None and best[end - 1] + unknown > top:
                    top, tokens = best[end - 1] + unknown, count[end - 1] + len(text[end - 1].encode())
                best.append(top)
                count.append(tokens)
            before = text
            yield word, count[-1]

    def batch(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut, known, older = [x.split() for x in texts], self.known, self.older
        new = {w for ws in cut for w in ws if w not in known}
        known.update((w, older[w]) for w in new if w in older)
        known.update(self.terminal_counts(sorted(w for w in new if w not in older)))
        got = [(len(ws), sum(map(known.__getitem__, ws))) for ws in cut]
        self.held += sum(map(len, new)) + ENTRY * len(new)
        if self.held > MEMO:
            self.older, self.known, self.held = known, {}, 0
        return got


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens and n_tokens for each row, under the vocabulary in the file at `path`.

    Null, empty and blank texts have 0 of both. Repeated rows are counted each; other columns
    are ignored; ids are of any type. A word of any length is scored whole. Pre-tokens are what
    white space of any kind in Unicode separates.
    """
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _COUNTERS.clear)
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(piece_vocabulary(path))
        own = _COUNTERS[path]
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [g for i, j in groups([len(x) for x in texts]) for g in own.batch(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], schema=out)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {name}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
