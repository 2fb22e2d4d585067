import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from tidemark.llm import exact_dedup, simhash, suffix_dedup
from tidemark.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        body = "".join(c for c in (t or "") if c not in WHITE)
        groups[body].append((-len(t or ""), i is None, i))
    return {body: (min(g)[2], len(g)) for body, g in groups.items()}


def check_exact(spark, docs_of, rows, **how):
    expected = brute_exact(rows)
    docs = docs_of(rows)
    got = exact_dedup.exact_groups(docs, **how).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append("".join(c for c in (t or "") if c not in WHITE))
    for r in got:
        bodies = [b for b in by_id[r["doc_id"]] if hashlib.sha256(b.encode()).hexdigest() == r["text_sha256"]]
        assert bodies and (r["keep_id"], r["group_size"]) == expected[bodies[0]]
    assert sum(r["kept"] for r in got) == len(expected)
    kept = exact_dedup.distinct_rows(docs, **how)
    assert kept.columns == docs.columns and kept.count() == len(expected)


def test_exact(spark, docs_of):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (9, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "a\u00a0b"), (8, "x" * 100_000), (10, "x" * 100_000 + " "), (11, "same"), (11, "same"), (None, "ab "), (None, "null id")]
    check_exact(spark, docs_of, rows)
    assert exact_dedup.exact_groups(docs_of(rows).limit(0)).count() == 0


def test_exact_with_hot_texts(spark, docs_of):
    random.seed(1)
    rows = [(i, random.choice(["hot text", "hot  text", "hottext"]) if i % 2 else f"text {i % 70}") for i in range(900)] + [(7, "hottext"), (7, "hottext")]
    rows += [(5, None), (None, "hottext"), (None, "hot text")]
    for share in (0.05, 0.3, None):
        check_exact(spark, docs_of, rows, hot_share=share)


def brute_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", " \n", "One", "ONE two", "a b c d e f g", "É A É a é", "w " * 500, "x" * 70_000):
        assert simhash.fingerprint(text.encode(), 4) & (1 << 64) - 1 == brute_fingerprint(text, 4)


def brute_components(prints, distance):
    """Smallest id reachable from each."""
    ids = list(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= distance and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for b in base.tolist():
        for flips in (0, 1, 2, 3, 4, 5, 6, 9):
            prints.add(b ^ sum(1 << int(x) for x in rng.choice(64, flips, replace=False)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (0, 1, 3, 4, 7):
        for radius in (0, 1, 2):
            got = {(r["u"], r["v"]) for r in simhash.links(frame, distance, radius).collect()}
            assert got == {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


def test_near_duplicates(spark, docs_of):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        text = [random.choice(words) for _ in range(300)]
        rows.append((1000 - i, " ".join(text)))
        for k in range(3):
            text[random.randrange(300)] = "edited"
            rows.append((2000 + 10 * i + k, " ".join(text).upper()))
    rows += [(1, None), (2, ""), (3, "  "), (4, "two words"), (5, "two  words"), (7, rows[0][1]), (7, rows[0][1])]
    got = simhash.near_duplicates(docs_of(rows), 4, 4).collect()
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    least = brute_components(prints, 4)
    assert len(got) == len(rows)
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16 and r["component_id"] == least[r["doc_id"]] for r in got)
    docs = docs_of([*rows, (None, "of no id"), (None, "of no id"), (None, rows[0][1]), (2, "two words"), (4, "a text under a second id")])
    kept = simhash.representatives(docs, 4, 4)
    expected = [(i, t) for i, t in dict(rows).items() if least[i] == i and i != 4] + [(None, "of no id"), (2, "two words"), (4, "a text under a second id")]
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert simhash.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 999) for i in range(200)] + [(5000, 4000)]
    random.seed(3)
    names = list(range(6000))
    random.shuffle(names)
    renamed = [(max(names[a], names[b]), min(names[a], names[b])) for a, b in edges]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(renamed, "u long, v long").repartition(4)).collect()}
    for group in (range(61), range(999, 1200), (4000, 5000)):
        least = min(names[x] for x in group)
        assert all(got.get(names[x], names[x]) == least for x in group)


def brute_repeats(rows, length=50):
    first, raw = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(raw, key=lambda r: (r[0] is None, r[0])):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            least = first[b[p : p + length]]
            if least is not None and (i is None or least < i):
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", (6000, 64 << 20))
    random.seed(4)
    words = ["the", "of", "aa", "bé", "x" * 7, "日本", "a" * 30]
    passages = [" ".join(random.choice(words) for _ in range(40)) for _ in range(9)]
    rows = []
    for i in range(150):
        parts = [random.choice(passages)[random.randint(0, 60) : random.randint(60, 200)] if random.random() < 0.5 else " ".join(random.choice(words) for _ in range(20)) for _ in range(random.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(300, None), (301, ""), (302, "ab" * 2000), (303, "ab" * 1500), (304, "a" * 49), (305, "a" * 50), (306, "a" * 51), (None, passages[0]), (7, passages[1]), (7, passages[1])]
    out = suffix_dedup.remove_repeats(docs_of(rows, 5), keep_text=True).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]
    assert sorted(got, key=str) == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in out)
    assert suffix_dedup.remove_repeats(docs_of(rows).limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs_of([(1, None), (2, "short")])).count() == 2


def test_repeats_around_a_line_that_all_documents_hold(spark, docs_of, monkeypatch):
    """Random text around one line of 40 letters: the windows over it go one by one, and no bucket holds them all."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", (6000, 64 << 20))
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 8000)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = "this line stands in every document here."
    rows = [(i, noise(rng.randint(0, 120)) + line + noise(rng.randint(0, 120))) for i in range(300)]
    rows += [(1000 + i, rows[i][1][:-30] + noise(20)) for i in range(60)] + [(2000, line * 30), (2001, line * 20), (None, rows[3][1]), (5, rows[5][1])]
    out = suffix_dedup.remove_repeats(docs_of(rows, 4)).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute_repeats(rows)


def test_phrases_of_one_name_are_told_apart():
    import pyarrow as pa

    chunk = suffix_dedup.Chunk(pa.table({"doc_id": [1, 2, 3], "text": ["a" * 60, "b" * 60, "a" * 60]}))
    runs = suffix_dedup.find_runs(chunk)
    same = np.zeros(len(runs.start), dtype=np.uint64)
    number, _, _ = suffix_dedup._phrases(chunk, runs._replace(names=(same, same)), suffix_dedup.LENGTH)
    exact, _, _ = suffix_dedup._phrases(chunk, runs, suffix_dedup.LENGTH)
    assert len(set(number)) == len(set(exact)) and all((number[i] == number[j]) == (exact[i] == exact[j]) for i in range(len(number)) for j in range(len(number)))


def test_splitters_part_anchors_of_one_lead(spark, docs_of):
    """Eight leading bytes that all anchors share do not put them into one bucket."""
    rng = random.Random(6)
    rows = [(i, " ".join("prefixed" + "".join(rng.choice("abcdefgh") for _ in range(16)) for _ in range(20))) for i in range(200)]
    bounds = suffix_dedup._splitters(docs_of(rows), sum(len(t) for _, t in rows), 16, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    assert len(bounds) == 15
