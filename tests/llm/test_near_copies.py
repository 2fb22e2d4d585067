"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from test_dedup import brute_fingerprint
from tidemark.llm import near_copies


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Smallest id of each row's group."""
    sets, least = [shingle_set(t) for _, t in rows], [i for i, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != least[b]
            least[a] = least[b] = low
    return least


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(words, k=30))
    rows = []
    for base in range(40):
        text = rng.choices(words, k=rng.choice([12, 60, 300]))
        for edits in (0, 1, 2, 4, 6):
            copy = list(text)
            for _ in range(edits * len(text) // 100 + (edits > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (f" {common}" if base % 3 == 0 else "")))
    hot = rng.choices(words, k=120)
    for _ in range(60):
        copy = list(hot)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            copy[at] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    # Similarity of exactly 0.8 (8 shingles of 10 in all), and just below.
    line = [f"x{k}" for k in range(13)]
    rows += [(1000, " ".join(line[:12])), (1001, " ".join([*line, "z"])), (1002, " ".join([*line[:12], "a", "b", "c"]))]
    return [*rows, (1010, "one two"), (1011, "ONE  two"), (1012, "one"), (1013, None), (1014, ""), (1015, " \n")]


def test_stage_finds_every_similar_pair(spark, docs_of):
    rows = corpus(random.Random(3))
    expected = brute_groups(rows)
    got = {r["id"]: r["component_id"] for r in near_copies.groups(docs_of(rows)).collect()}
    assert got == {i: least for (i, _), least in zip(rows, expected)}
    text = dict(rows)
    far = [i for (i, t), least in zip(rows, expected) if least != i and (brute_fingerprint(t, 5) ^ brute_fingerprint(text[least], 5)).bit_count() > 4]
    assert far  # fingerprints alone miss these
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(rows), "unused")
    assert kept.columns == docs_of(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_order_of_shingles_changes_no_result(spark, docs_of, monkeypatch):
    rows = corpus(random.Random(4))
    expected = {i: least for (i, _), least in zip(rows, brute_groups(rows))}
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(near_copies, "FREQUENT", 5)
    assert {r["id"]: r["component_id"] for r in near_copies.groups(docs_of(rows)).collect()} == expected


def test_repeated_rows_and_null_ids(docs_of):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, "alone"), (7, "another text of a few words")]
    got = sorted((str(r["id"]), str(r["component_id"])) for r in near_copies.groups(docs_of(rows)).collect())
    assert got == [("1", "1"), ("3", "1"), ("3", "1"), ("7", "7"), ("None", "1"), ("None", "None")]
    assert near_copies.groups(docs_of(rows).limit(0)).count() == 0


def test_one_row_of_each_group(docs_of):
    """Null and repeated ids are rows like others: three copies of one text leave one."""
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, "alone"), (None, "alone"), (7, "another text of a few words"), (7, "a b c d e f"), (1, "one more text of this id"), (5, "one more text of this id")]
    docs = docs_of(rows)
    kept = near_copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(1, "A b c d e f"), (1, "one more text of this id"), (7, "another text of a few words"), (None, "alone")]
    repeated = docs_of([(1, "t"), (5, "t"), (None, "t")])
    assert [r["doc_id"] for r in near_copies.representatives(repeated).collect()] == [1]
    assert near_copies.representatives(repeated.limit(0)).count() == 0


def test_long_texts_of_different_length_meet(docs_of):
    """Texts so long that their sets meet in parts, also where one is halved more often than the other."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for size in (204, 205, 240, 256, 409, 410, 500, 511, 512, 900, 2100):
        text = rng.choices(words, k=size + 4)
        longer = size // 4
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text, *rng.choices(words, k=longer)])), (len(rows) + 2, " ".join([*rng.choices(words, k=longer + 1), *text]))]
        for share in (40, 30, 25):
            copy = list(text)
            for at in rng.sample(range(len(copy)), len(copy) // share):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    expected = {i: least for (i, _), least in zip(rows, brute_groups(rows))}
    assert len(rows) > len(set(expected.values())) > 11
    assert {r["id"]: r["component_id"] for r in near_copies.groups(docs_of(rows)).collect()} == expected


def test_pairs_that_cannot_be_similar_do_not_meet(docs_of, monkeypatch):
    """Copies with too many changes, and long texts that share a passage: few of their pairs are compared."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for size in (300, 1500):
        text = rng.choices(words, k=size)
        for _ in range(24):
            copy = list(text)
            for at in rng.sample(range(size), size // 16):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    passage = rng.choices(words, k=6)
    rows += [(len(rows) + k, " ".join([*rng.choices(words, k=1200), *passage])) for k in range(24)]
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 1)
    met, meeting = [], near_copies._meeting

    def counted(cells):
        pairs = meeting(cells)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "_meeting", counted)
    got = {r["id"]: r["component_id"] for r in near_copies.groups(docs_of(rows)).collect()}
    assert got == {i: least for (i, _), least in zip(rows, brute_groups(rows))}
    assert sum(met) <= len(rows)
