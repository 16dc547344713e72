"""Identifiers found by context: planted ones with precision and recall, and all spans against a plain version."""

import collections
import random

import regex
from pyspark.sql import functions as F

from framesieve.llm import pii

DOCS = "doc_id long, text string"


def luhn_card(rng, valid=True):
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
    return "".join(map(str, digits)) + str((-total + (0 if valid else 1)) % 10)


def planted(seed=1):
    """Texts with known identifiers, and with some that no base pattern takes; and what stands there: (doc_id, kind, found)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    leads = {0: ["please write to", "reach me under"], 1: ["connect to host", "the server address"], 2: ["charged credit card", "the card number"], 3: ["call us on", "our phone number"]}
    known = {
        0: lambda: f"{word()}.{word()}@{word()}.org", 1: lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 2: lambda: luhn_card(rng),
        3: lambda: f"+{rng.randint(1, 9)} {rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}",
    }
    hidden = {
        0: [lambda: f"{word()} (at) {word()} (dot) org", lambda: f"{word()} at {word()} dot net", lambda: f"{word()}[at]{word()}.com", lambda: f"{word()}#{word()}7"],
        1: [lambda: "[.]".join(str(rng.randrange(256)) for _ in range(4)), lambda: "-".join(str(rng.randrange(256)) for _ in range(4))],
        2: [lambda: luhn_card(rng, False), lambda: ".".join(luhn_card(rng)[k : k + 4] for k in (0, 4, 8, 12)).replace(".", " . ")],
        3: [lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f"{rng.randint(200, 999)}.555.{rng.randint(1000, 9999)}"],
    }
    texts, there = [], set()
    for kind, make in known.items():
        for lead in leads[kind]:
            for _ in range(60):
                texts.append(f"{prose(9)} {lead} {make()} {prose(6)}")
            for way in hidden[kind]:
                for _ in range(2):
                    found = way()
                    there.add((len(texts), kind, found))
                    texts.append(f"{prose(9)} {lead} {found}, {prose(6)}")
    for _ in range(60):  # numbers and marks that are nobody's
        n = rng.choice([str(rng.randint(1000, 10**9)), f"{rng.randint(1, 99)} of {rng.randint(100, 999)}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", luhn_card(rng, False), f"look at {word()} dot", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"v{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}"])
        texts.append(f"{prose(9)} {n} {prose(6)}")
    # every kind's context, with something that can't be of the kind
    texts += [f"{prose(5)} {lead} {other} {prose(3)}" for kind, other in ((0, "12345678"), (1, "1234567"), (2, "room12a"), (3, "a1b2c3d4")) for lead in leads[kind]]
    return texts, there


def test_planted_identifiers(spark):
    texts, there = planted()
    made = pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS), ["doc_id"]).collect()
    found = {(r.doc_id, s.kind, texts[r.doc_id][s.start : s.end]) for r in made for s in r.extra}
    right = len(found & there)
    assert right / len(there) >= 0.95 and right / len(found) >= 0.98, (there - found, found - there)
    assert {k for _, k, _ in found} == {0, 1, 2, 3} and not any(r.secrets for r in made)


def java(pattern):
    return regex.compile(pattern.replace(r"\x20", " "), regex.ASCII | regex.VERSION1)


def occurrences(text, pattern):
    """(start, found, before, after) of all matches, with what lies between them."""
    spans = [m.span() for m in java(pattern).finditer(text)]
    for k, (a, b) in enumerate(spans):
        low, high = spans[k - 1][1] if k else 0, spans[k + 1][0] if k + 1 < len(spans) else len(text)
        before = text[max(low, a - pii.BEFORE) : a]
        yield a, text[a:b], before if k == 0 or len(before) == pii.BEFORE else "0" + before, text[b : min(high, b + pii.BEFORE)] + "0"


def patterns(before, found, after):
    shape = regex.sub("[0-9]+", "0", regex.sub(r"\p{L}+", "a", found))
    out = []
    if m := regex.search(r"(?:^|\s)([^\s0-9@]{1,40}\s{1,4}[^\s0-9@]{1,40})\s{1,4}[\"'`(<\[{]*$", before):
        out.append("two " + regex.sub(r"\s+", " ", m[1]))
    if m := regex.search(r"(?:^|\s)([^\s0-9@]{1,40})\s{1,4}[\"'`(<\[{]*$", before):
        out.append(f"one {m[1]} {shape}")
    if m := regex.search(r"^[\"'`)>\]}.,;:!?*$%&#|]*\s{1,4}([^\s0-9@]{1,40})(?:\s|$)", after):
        out.append(f"next {m[1]} {shape}")
    return [p.lower() for p in out]


def valid(kind, found):
    digits = regex.sub("[^0-9]", "", found)
    total = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits))))
    return {0: True, 1: all(int(x) <= 255 for x in found.split(".")) if kind == 1 else True, 2: 14 <= len(digits) <= 19 and total % 10 == 0, 3: 10 <= len(digits) <= 15}[kind]


def brute(texts, rounds=pii.ROUNDS, confidence=pii.CONFIDENCE, support=pii.SUPPORT):
    """Extra spans (doc, start, kind, end), from the text on."""
    rows = []
    for d, text in enumerate(texts):
        base = []
        for k, kind in enumerate(pii.KINDS):
            for a, found, before, after in occurrences(text, pii.PATTERNS[kind]):
                if valid(k, found):
                    base.append((a, a + len(found)))
                    rows.append((d, a, k, a + len(found), found, 1 << k, patterns(before, found, after)))
        taken, said = list(base), []
        for a, found, before, after in [*occurrences(text, pii.SPELLED), ("then",) * 4, *occurrences(text, pii.CANDIDATE)]:
            if a == "then":  # tokens of an address that is spelled out aren't candidates of their own
                taken += said
                continue
            opening, bare = java(pii.OPENING).match(found), found
            if opening:
                a, bare = a + len(opening[0]), found[len(opening[0]) :]
            bare = java(pii.CLOSING).sub("", bare)
            closing = java(pii.CLOSING).search(found)
            if len(bare) < pii.LEAST or any(a < y and x < a + len(bare) for x, y in taken):
                continue
            said.append((a, a + len(bare)))
            fits = sum(1 << k for k, name in enumerate(pii.NAMES) if java(pii.FITS[name]).search(bare))
            kind = pii.SECRET if java(pii.KEY).search(bare) else -1
            rows.append((d, a, kind, a + len(bare), bare, fits, patterns(before, bare, (closing[0] if closing else "") + after)))
    edges, kinds, bits = collections.Counter(), {}, {}
    for _, _, kind, _, found, fits, has in rows:
        for p in has:
            edges[p, found] += 1
            kinds[p, found], bits[p, found] = max(kind, kinds.get((p, found), -1)), max(fits, bits.get((p, found), 0))
    trusted = {}
    for (_, i), k in kinds.items():
        if k >= 0:
            trusted[i] = max(k, trusted.get(i, -1))
    for last in range(rounds - 1, -1, -1):
        of = collections.defaultdict(dict)
        for (p, i), n in edges.items():
            of[p][i] = n
        confident = {}
        for p, has in of.items():
            best = max(((sum(n for i, n in has.items() if trusted.get(i) == k), sum(trusted.get(i) == k for i in has), k) for k in {trusted[i] for i in has if i in trusted}), default=None)
            if best and best[1] >= support and best[0] / sum(has.values()) >= confidence:
                confident[p] = (best[0] / sum(has.values()), best[1], best[2])
        if last:
            learned = [(i, confident[p][2]) for (p, i), k in kinds.items() if k < 0 and p in confident and bits[p, i] >> confident[p][2] & 1]
            for i, k in learned:
                trusted[i] = max(k, trusted.get(i, -1))
    out = []
    for d, a, kind, b, _, fits, has in rows:
        named = [confident[p] for p in has if p in confident and fits >> confident[p][2] & 1]
        if kind in (-1, pii.SECRET) and named:
            out.append((d, a, max(named)[2], b))
    return sorted(out)


def test_extra_spans_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["mail", "me at", "call", "id", "x1y2z3", "+1 743 555 1234", "(743) 555-1234", "a.b@c.org", "a.b at c dot org", "[at]", "4111111111111111", "4111111111111112", "1.2.3.4", "1[.]2[.]3[.]4", '"', "(", ")", ",", "9" * 12, "ab#cd1", "f00d" * 9, "deadbeef0123456789deadbeef0123456789", "key =", "12 34 56 78 90"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + planted(2)[0][::2]
    made = pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS), ["doc_id"], confidence=0.5, support=2).collect()
    found = sorted((r.doc_id, s.start, s.kind, s.end) for r in made for s in [*r.extra, *r.secrets])
    assert found == brute(texts, confidence=0.5, support=2) and len(found) > 20


def test_long_texts_stay_linear(spark):
    texts = ["1 " * 200_000, "a at " * 100_000, "(" * 300_000 + "1", "1.2-3/" * 60_000, "a#" * 200_000, "x at y dot " * 50_000, "7" * 500_000]
    assert pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS), ["doc_id"]).where(F.size("base") >= 0).count() == len(texts)
