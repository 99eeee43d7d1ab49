"""Personal data, also in disguise: e-mail and IP addresses, card and phone numbers.

The base patterns run over the text as it is. Then transducers rewrite what may hide an
identifier - look-alike letters, invisible characters, spelled digits, at and dot written as
words or in brackets - and keep for every character of the result the span of the source that
it stands for. Identifiers found in the rewritten text are mapped back to source spans and
added where at least one of their characters was rewritten. Offsets are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_type
from .workers import claim

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match begins where its first run of digits does: within the run no later start can do better.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}

_D = "zero|one|two|three|four|five|six|seven|eight|nine"
#: A spelled digit, a plus or written digits. Letters of other scripts that ignoring case takes for these words are folded by _folded().
ITEM = re.compile(rf"(?i)\b(?:({_D}|oh)|(plus))\b|[0-9]+")
#: What may part the digits of one run; commas part runs as well.
BETWEEN = re.compile(r"[\x20,-]+"), re.compile(r"[\x20-]+")
AFTER = re.compile(r"(?i)[\x20]*+(?:[\[({<][\x20]*+)?(?:dot\b|\.)")
#: Spaces before a bracket, taken from their first one on: tried from every space of a long run they would cost its square.
_OPEN = r"(?:(?<![\x20])[\x20]*+)?+[\[({<][\x20]*+"
AT = re.compile(rf"(?i){_OPEN}at[\x20]*+[\])}}>][\x20]*+|{_OPEN}@[\x20]*+[\])}}>][\x20]*+|(?<=[a-z0-9])[\x20]++at[\x20]++(?=[a-z0-9-]++(?:[\x20]++dot[\x20]++|[\x20]*+[\[({{<][\x20]*+dot[\x20]*+[\])}}>][\x20]*+|\.)[a-z0-9])|(?<=[a-z0-9])[\x20]++@[\x20]*+(?=[a-z0-9-]++\.[a-z])|(?<=[a-z0-9])@[\x20]++(?=[a-z0-9-]++\.[a-z])")
DOT = re.compile(rf"(?i){_OPEN}(?:dot|\.)[\x20]*+[\])}}>][\x20]*+|(?<=[a-z0-9])[\x20]++dot[\x20]++(?=[a-z0-9])")


def _character_class() -> str:
    """All single characters that a transducer rewrites: look-alikes, invisible ones, digits and full-width forms of ASCII."""
    rest = [chr(c) for c in range(0x80, 0x1FBFA) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Nd"]
    return "[" + re.escape("".join([*LOOKALIKE, *INVISIBLE, *rest])) + "！-～]"


SINGLE = re.compile(_character_class())


def plain(ch: str) -> str:
    """What a rewritten character stands for: one ASCII character, or none."""
    if ch in INVISIBLE:
        return ""
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    if "！" <= ch <= "～":
        return chr(ord(ch) - 0xFEE0)
    return str(unicodedata.digit(ch))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base patterns, leftmost and non-overlapping of each kind."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = LOCAL.search(text, _local_start(text, end, at), at).start()
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        out += [("card", *m.span()) for m in CARD.finditer(text) if _card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def _local_start(text: str, least: int, at: int) -> int:
    """Start of the run of local characters that ends at `at`."""
    k = at
    while k > least and (text[k - 1].isascii() and (text[k - 1].isalnum() or text[k - 1] in "._%+-")):
        k -= 1
    return k


def _card(match: str) -> bool:
    digits = NO_DIGIT.sub("", match)
    if not 13 <= len(digits) <= 19:
        return False
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


class Rewritten:
    """A text with the source span of each stretch that a transducer has changed."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = [0]  # where a stretch begins in the rewritten text
        self.source: list[tuple[int, int, bool]] = [(0, len(text), False)]  # its source span; True if rewritten

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span, and whether anything in it was rewritten."""
        a = bisect.bisect_right(self.starts, start) - 1
        b = bisect.bisect_right(self.starts, end - 1) - 1
        own = self.source[a : b + 1]
        changed = any(s[2] for s in own) or any(s[1] != t[0] for s, t in zip(own, own[1:], strict=False))  # a gap: characters left out
        s, e = self.source[a], self.source[b]
        first = s[0] if s[2] else s[0] + start - self.starts[a]
        last = e[1] if e[2] else e[0] + end - self.starts[b]
        return first, last, changed

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """The text with each (start, end, replacement) made, in ascending order."""
        out, parts, size, here = Rewritten(""), [], 0, 0
        out.starts, out.source = [], []

        def add(piece: str, source: tuple[int, int, bool]) -> None:
            nonlocal size
            if piece:
                out.starts.append(size)
                out.source.append(source)
                parts.append(piece)
                size += len(piece)

        def copy(start: int, end: int) -> None:
            k = bisect.bisect_right(self.starts, start) - 1
            while start < end:
                stop = min(end, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                s = self.source[k]
                add(self.text[start:stop], s if s[2] else (s[0] + start - self.starts[k], s[0] + stop - self.starts[k], False))
                start, k = stop, k + 1

        for start, end, new in edits:
            copy(here, start)
            first, last, _ = self.span(start, end)
            add(new, (first, last, True))
            here = end
        copy(here, len(self.text))
        out.text = "".join(parts)
        return out


def _folded(text: str) -> str:
    """Lower case, with what ignoring case takes for s and i: U+017F, U+0130 and U+0131."""
    low = text.lower()
    return low if low.isascii() else low.replace("\u017f", "s").replace("\u0131", "i").replace("i\u0307", "i")


def _dot_before(text: str, k: int) -> bool:
    """Whether a dot, written or spelled, perhaps in brackets, ends at k but for spaces."""
    while k and text[k - 1] == " ":
        k -= 1
    if k and text[k - 1] in "])}>":
        k -= 1
        while k and text[k - 1] == " ":
            k -= 1
    return text[k - 1 : k] == "." or (text[max(0, k - 3) : k].lower() == "dot" and not text[max(0, k - 4) : k - 3].isalnum())


def _spelled(text: str, between: re.Pattern) -> list[tuple[int, int, str]]:
    """Edits that write spelled digits as digits, where three stand together or one stands by a digit, a plus or a dot.

    Digits with nothing but `between` between them are one run, written without it.
    """
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        words = sum(i[1] is not None for i in run)
        if not words:
            return
        start, end = run[0].start(), run[-1].end()
        edge = start
        while edge and text[edge - 1] == " ":
            edge -= 1
        plus = text[edge - 1 : edge] == "+"
        if words < 3 and words == len(run) and not plus and not AFTER.match(text, end) and not _dot_before(text, start):
            return
        # One stretch for each digit, the separator before it included.
        edge = edge if plus else start
        for i in run:
            edits.append((edge, i.end(), SPELLED[_folded(i[0])] if i[1] or i[2] else i[0]))
            edge = i.end()

    for i in ITEM.finditer(text):
        if run and (i[2] or not between.fullmatch(text, run[-1].end(), i.start())):
            close()
            run = []
        run.append(i)
    close()
    return edits


def rewrite(text: str) -> Iterator[Rewritten]:
    """The text after all transducers, with each way to part runs of spelled digits and with these left as they are. Nothing if nothing changes."""
    now, changed = Rewritten(text), False
    if not text.isascii():
        edits = [(m.start(), m.end(), plain(m[0])) for m in SINGLE.finditer(text)]
        if edits:
            now, changed = now.apply(edits), True
    low = _folded(now.text)
    ways: list[list[tuple[int, int, str]]] = [[]]
    if any(w in low for w in SPELLED if w != "plus"):
        for between in BETWEEN:
            if (edits := _spelled(now.text, between)) not in ways:
                ways.append(edits)
    dotted = any(x in low for x in ("dot", "@", "(", "[", "{", "<", " at "))
    for way in ways:
        this, edited = (now.apply(way), True) if way else (now, changed)
        for pattern, new in ((AT, "@"), (DOT, ".")) if dotted else ():
            edits = [(m.start(), m.end(), new) for m in pattern.finditer(this.text)]
            if edits:
                this, edited = this.apply(edits), True
        if edited:
            yield this


def all_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those that rewriting brings to light, by kind and start."""
    found = set(base)
    for now in rewrite(text):
        for kind, start, end in base_spans(now.text):
            first, last, changed = now.span(start, end)
            if changed:
                found.add((kind, first, last))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row.

    Null counts as empty: no spans. Texts are searched whole; every pattern runs in time
    proportional to the text. Repeated rows get a result each; ids are of any type; other
    columns are ignored.
    """
    counts = [f"n_{k}" for k in KINDS]
    kind, name = id_type(docs, id_col)
    out = pa.schema([("id", kind), *[(c, pa.int64()) for c in counts], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                kinds = [s[0] for s in base]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(_written(base).encode()).hexdigest(), _written(all_spans(text, base))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, out.types[1:], strict=True)]], schema=out)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {name}, {', '.join(c + ' long' for c in counts)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in angle brackets; other columns stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                if text is not None:
                    parts, here = [], 0
                    for kind, start, end in sorted(all_spans(text, base_spans(text)), key=lambda s: (s[1], -s[2])):
                        if start >= here:
                            parts += [text[here:start], f"<{kind}>"]
                            here = end
                    text = "".join([*parts, text[here:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
