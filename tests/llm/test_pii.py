import hashlib
import random
import re

import pytest

from faultline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            yield kind, m.start(), m.end()


TEXTS = [
    "", "a.b+c@x-y.example.com, x@y, @z.com, a@b.c@d.e", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 0.0.0.0000000001", "4111 1111-1111 1111 and 4111111111111112",
    "call +1 (328) 555-8087. or +12 or + 1", "é +49 30 123456-7 ñ a@é.com", "." * 50 + "@a.b", "1" * 3000 + ".1.1.1", "+1" * 20,
]


def test_base_equals_the_patterns():
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("a1.@+- 0(9)é%4") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == list(brute(t)), t


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to jane.doe (at) mail (dot) example (dot) com now", "email", "jane.doe (at) mail (dot) example (dot) com"),
    ("write to jane at example dot com now", "email", "jane at example dot com"),
    ("write to jane[at]example[dot]org.", "email", "jane[at]example[dot]org"),
    ("write to jаne@exаmple.com now", "email", "jаne@exаmple.com"),
    ("write to ja​ne@example.com now", "email", "ja​ne@example.com"),
    ("call plus one five five five zero one two three four five six please", "phone", "plus one five five five zero one two three four five six"),
    ("card four one one one 1111 one one one one 1111 then", "card", "four one one one 1111 one one one one 1111"),
    ("card ４１１１ １１１１ １１１１ １１１１ then", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("host 10 dot 0 dot 0 dot 1 there", "ip", "10 dot 0 dot 0 dot 1"),
    ("host 10[.]0[.]0[.]1 there", "ip", "10[.]0[.]0[.]1"),
])
def test_disguises_map_back(text, kind, part):
    spans = pii.all_spans(text, pii.base_spans(text))
    assert (kind, text.index(part), text.index(part) + len(part)) in spans


def test_clean_texts_stay_clean():
    for t in ("we met at noon and dot the line", "one or two or three of them", "Привет, как дела", "the dot at the end. look at that", "one two three four"):
        assert pii.all_spans(t, pii.base_spans(t)) == []


def test_table_and_redaction(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(50, None, "x"), (51, "jane at example dot com", "x"), (51, "jane at example dot com", "x"), (None, "a@b.cd", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.find_pii(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        base = list(brute(t or ""))
        w = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *[[b[0] for b in base].count(k) for k in BASE], hashlib.sha256(w.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=str)
    for g, (base, spans) in zip(got, [(g[5], g[6]) for g in got], strict=True):
        assert spans or base == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs.where("false")).collect() == []
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[51] == "<email>" and red[None] == "<email>" and red[50] is None and pii.redact(docs).columns == docs.columns


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "+1" + " " * 200_000, "one " * 50_000, " at" * 60_000, "1." * 100_000):
        pii.all_spans(t, pii.base_spans(t))


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("host 192 dot one six eight dot zero dot one there", "ip", "192 dot one six eight dot zero dot one"),
    ("host 10 dot zero dot 0 dot 1 there", "ip", "10 dot zero dot 0 dot 1"),
    ("host 10.0.zero.1 there", "ip", "10.0.zero.1"),
    ("host ten[.]one, 10[.]0[.]zero[.]one there", "ip", "10[.]0[.]zero[.]one"),
    ("call +49 one seven 0 1234567 now", "phone", "+49 one seven 0 1234567"),
    ("call + four nine 170 1234567 now", "phone", "+ four nine 170 1234567"),
    ("card 4 one one one 1111 1111 1111 then", "card", "4 one one one 1111 1111 1111"),
    ("card 4 one one one 1111 1111 1111 1111 then", "card", None),
    ("\u0130 call plus one five five five zero one two three four five six please", "phone", "plus one five five five zero one two three four five six"),
    ("call plus one \u017fix five five zero one two three four five six please", "phone", "plus one \u017fix five five zero one two three four five six"),
    ("write to jane.doe at example.com now", "email", "jane.doe at example.com"),
    ("host 10 dot 0 dot 0 dot 1 one", "ip", "10 dot 0 dot 0 dot 1"),
])
def test_single_spelled_digits_and_dots(text, kind, part):
    spans = pii.all_spans(text, pii.base_spans(text))
    assert ((kind, text.index(part), text.index(part) + len(part)) in spans) if part else spans == []


def test_prose_with_spelled_digits_stays_clean():
    for t in ("one. Two, or three. Four", "the only one", "chapter 4, one of 12 parts", "plus one", "at one dot two", "look at this. one more"):
        assert pii.all_spans(t, pii.base_spans(t)) == [], t


def test_mixed_runs_take_linear_time():
    for t in ("1 " * 100_000 + "x one", "one 1 " * 50_000, "plus " * 50_000 + "one", "." + " " * 100_000 + "one", "one" + " " * 100_000, "a at b." * 30_000, "one. " * 40_000):
        pii.all_spans(t, pii.base_spans(t))


def plain_rewriting(text):
    """The rewritten texts, character by character: (character, first and last source place, whether rewritten)."""

    def applied(chars, edits):
        out, here = [], 0
        for start, end, new in edits:
            out += chars[here:start]
            own = chars[start:end]
            out += [(c, own[0][1], own[-1][2], True) for c in new]
            here = end
        return out + chars[here:]

    string = lambda chars: "".join(c[0] for c in chars)
    first = [(c, k, k + 1, False) for k, c in enumerate(text)]
    single = applied(first, [(m.start(), m.end(), pii.plain(m[0])) for m in pii.SINGLE.finditer(text)])
    for edits in [[], *[pii._spelled(string(single), b) for b in pii.BETWEEN]]:
        now = applied(single, edits)
        for pattern, new in ((pii.AT, "@"), (pii.DOT, ".")):
            now = applied(now, [(m.start(), m.end(), new) for m in pattern.finditer(string(now))])
        yield now


def brute_all(text):
    found = set(brute(text))
    for now in plain_rewriting(text):
        for kind, a, b in brute("".join(c[0] for c in now)):
            own = now[a:b]
            # Something in it was rewritten, or characters between two of its own were left out.
            if any(c[3] for c in own) or any(x[2] != y[1] for x, y in zip(own, own[1:], strict=False)):
                found.add((kind, own[0][1], own[-1][2]))
    return sorted(found, key=lambda s: (list(BASE).index(s[0]), s[1], s[2]))


def test_added_spans_equal_plain_rewriting():
    rng = random.Random(21)
    bits = ["one", "two", "zero", " dot ", " at ", "(at)", " [dot] ", "@", ".", " ", "  ", "1", "49", "+", "plus ", "a", "jane", "host", "org", "а", "е", "​", "４", "４１１１", "4111", "-", "(", ")", ",", "é", "ſix"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    assert sum(len(brute_all(t)) > len(list(brute(t))) for t in texts) > 200
    for t in texts:
        assert pii.all_spans(t, pii.base_spans(t)) == brute_all(t), t


def test_time_is_in_proportion_to_the_text():
    import time

    def took(t):
        began = time.process_time()
        pii.all_spans(t, pii.base_spans(t))
        return time.process_time() - began

    for make in (lambda n: "(" + " " * n, lambda n: "x (at) " + " " * n + "y", lambda n: " " * n + "[dot", lambda n: "( " * n, lambda n: "a at " * n, lambda n: "a @" + " " * n, lambda n: "." * n + " dot ", lambda n: "( " + "at " * n, lambda n: " (at) (dot)" * n, lambda n: "one dot " * n):
        small, large = took(make(40_000)), took(make(160_000))
        assert large < 8 * small + 0.3, (make(3), small, large)
