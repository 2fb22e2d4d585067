"""The bootstrap against a plain one over dictionaries, and its candidates and contexts against plain versions."""

import random
import re
import time
from collections import defaultdict

import pytest
from tidemark.llm import pii


def plain_bootstrap(texts, support=3, confidence=0.8):
    """Promoted patterns of a corpus: pattern -> (kind, confidence)."""
    edges, kinds, fits, unseen = defaultdict(set), {}, defaultdict(int), set()
    for text in texts:
        for a, b, kind in pii.occurrences(text or "", pii.base_spans(text or "")):
            i = pii.identity(text[a:b])
            for p in pii.patterns(text, a, b):
                edges[p].add(i)
                if kind < 0:
                    fits[p, i] |= pii.forms(text[a:b])
                    unseen.add((p, i))
            if kind >= 0:
                kinds[i] = min(kind, kinds.get(i, kind))
    known = {i: (k, 1_000_000) for i, k in kinds.items()}
    while True:
        good = {}
        for p, own in edges.items():
            for kind in range(4):
                scores = [known[i][1] for i in own if i in known and known[i][0] == kind]
                if len(scores) >= support and sum(scores) // len(own) >= int(confidence * 1_000_000):
                    good[p] = kind, sum(scores) // len(own)
        found = {}
        for p, (kind, score) in good.items():
            for i in edges[p]:
                if i not in known and fits[p, i] >> kind & 1:
                    found[i] = max(found.get(i, (-1, 0)), (score, -kind))
        if not found:
            return {p: g for p, g in good.items() if any((p, i) in unseen and fits[p, i] >> g[0] & 1 for i in edges[p])}
        known |= {i: (-minus, score) for i, (score, minus) in found.items()}


def corpus(seed=1):
    """Contexts of seeds, contexts that only what they find leads to, and contexts that tell nothing."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [f"{word()} please write to {word()}@mail{i}.example.com today {word()}" for i in range(150)]
    local = [f"{word()}@localhost" for _ in range(9)]
    rows += [f"please write to {x} today" for x in local]
    rows += [f"{word()} complaints go <{x}> {word()}" for x in local] + [f"so complaints go <{x}> then" for x in ("root@intranet",)]  # found in the second round
    rows += [f"{word()} call +49 30 555 {1000 + i} now, {word()}" for i in range(40)] + ["call (030) 555 1234 now, or", "call 030 555-9876 now, or", "call 12 now, or"]
    rows += [f"{word()} paid by card 4111 1111 1111 1111 in full" for _ in range(3)]
    luhn = [n for n in range(4_000_000_000_000_000, 4_000_000_000_000_300) if pii._luhn(str(n))][:20]
    rows += [f"paid by card {n} in full" for n in luhn] + ["paid by card 4000 0000 0000 0003 in full"]
    rows += [f"host 10.0.0.{i} up" for i in range(20)] + ["host fe80::1:2 up", "host 10.300.0.1 up"]
    rows += [f"on page {rng.randint(1, 900)} of {word()}" for _ in range(50)] + [f"from {word()}@x.example.com" for _ in range(5)] + [f"from {rng.randint(10**7, 10**8)} to" for _ in range(20)]
    rng.shuffle(rows)
    return rows


def plain_added(texts, promoted):
    out = {}
    for text in texts:
        for a, b, kind in pii.occurrences(text or "", pii.base_spans(text or "")):
            hits = sorted((-promoted[p][1], promoted[p][0]) for p in pii.patterns(text, a, b) if p in promoted and pii.forms(text[a:b]) >> promoted[p][0] & 1)
            if kind < 0 and hits:
                out.setdefault(text, []).append((pii.KINDS[hits[0][1]], a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrap_equals_a_plain_one(spark, docs_of, seed):
    texts = [*corpus(seed), None, ""]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3])]
    docs = docs_of(rows)
    expected = plain_bootstrap(texts)
    table = pii.bootstrap(docs)
    assert {r["pattern"]: (r["for_kind"], r["confidence"]) for r in table.collect()} == expected
    added = plain_added(texts, expected)
    values = {text[a:b] for text, spans in added.items() for _, a, b in spans}
    assert {"(030) 555 1234", "030 555-9876", "root@intranet", "4000 0000 0000 0003", "fe80::1:2", "10.300.0.1"} <= values and not {"12"} & values
    for few in (0, 100_000):  # joined and broadcast
        found = {(r["doc_id"], r["spans"]) for r in pii.find(docs, table, few).collect()}
        for i, text in rows:
            base = [(k, *s) for k, spans in pii.base_spans(text or "").items() for s in spans]
            assert (i, pii._join(base + added.get(text, []))) in found
        masked = pii.mask(docs, table, few)
        assert masked.columns == docs.columns and masked.count() == len(rows)
        assert masked.where("text = 'call <phone> now, or'").count() == 2 and masked.where("text is null").count() == 1


def test_no_seed_no_span(spark, docs_of):
    assert pii.bootstrap(docs_of([(1, "page 12 of 30"), (2, None)])).count() == 0
    assert pii.find(docs_of([(1, "a")]).limit(0)).count() == 0


CASES = {
    "call (030) 555 1234.": ["(030) 555 1234"], "no 4000 0000-0000 0003, x": ["4000 0000-0000 0003"], "mail john@localhost!": ["john@localhost"], "see (12)": ["(12)"],
    "a1 b 2c 3": ["a1", "2c", "3"], "at @ sign, @home and home@": [], "fe80::1 :: x": ["fe80::1"], "1 - 2 / 3": ["1 - 2", "3"], "1\n2": ["1", "2"], "+7 up": ["+7"], "x+": [], "7+ 8": ["7", "8"], "é5é": ["5"],
    "1" * 200 + "@" + "b" * 200: ["1" * 200 + "@" + "b" * 200],
}


def test_candidates():
    for text, expected in CASES.items():
        assert [text[a:b] for a, b in pii.candidates(text, 0, len(text))] == expected, text


def test_contexts_are_whole_words():
    rng = random.Random(4)
    bits = ["w" * 100, "a", " ", "\n", "  ", ",", "_", "é", "日本", "12", "(", "x" * 47, " " * 90]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        words = lambda t: [re.sub("[0-9]+", "0", w.lower()) for w in re.findall(r"[^\W_]+|[^\w\s]|_", t)]
        assert pii._words(text, start, -1) == words(text[:start])[::-1][:2] and pii._words(text, end, 1) == words(text[end:])[:2]


def test_time_in_proportion():
    def seconds(text):
        start = time.perf_counter()
        for a, b, _ in pii.occurrences(text, pii.base_spans(text)):
            pii.patterns(text, a, b)
        return time.perf_counter() - start

    for unit in ("a@b.cd ", "1 ", "1 a", "a@b ", "x1", "(1) ", "+1 ", "1.2.3.4 5", "a" * 50 + " 1 ", " " * 50 + "1"):
        seconds(unit * 2000)
        assert seconds(unit * 32_000) < 20 * seconds(unit * 4000) + 0.5, unit
