import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann, langid, pii, sharding

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "ois", "tion", "que"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, prose(lang := rng.choice(list(SYLLABLES)), rng.randint(3, 60), rng), lang) for i in range(400)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 .,;", "bb"), (903, prose("bb", 20_000, rng), None), (None, prose("cc", 30, rng), "aa"), (5, "ka ro", "aa"), (5, "ka ro", "aa")]
    docs = docs_of(rows + odd)
    model = langid.train(docs)
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.predict(docs, model).collect()}
    held_out = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i, lang) in got for i, lang in held_out) >= 0.98 * len(held_out) > 50
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for (i, _), r in got.items())
    assert {p for i, p in got if i in (900, 901, 902)} == {"und"} and (903, "bb") in got and (None, "cc") in got
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 3


def plain_language(rows, bits=langid.BITS):
    """Naive Bayes over the n-grams' buckets, one n-gram at a time."""

    def buckets(text):
        points = [ord(c) for c in f" {text.lower()} "]
        for n in langid.ORDERS:
            for at in range(len(points) - n + 1):
                h = n * 0x27D4EB2F & 0xFFFFFFFF
                for k in range(n):
                    h = (h ^ points[at + k] * int(langid.MULTIPLIERS[k]) & 0xFFFFFFFF) * int(langid.MULTIPLIERS[0]) & 0xFFFFFFFF
                    h ^= h >> 15
                yield h >> (32 - bits)

    counts, numbers = {}, {}
    for i, t, lang in rows:
        if t is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            numbers[lang] = numbers.get(lang, 0) + 1
            for b in buckets(t):
                counts.setdefault(lang, {}).setdefault(b, 0)
                counts[lang][b] += 1
    seen = set().union(*counts.values())
    # Buckets that no example has weigh a hundredth in the totals.
    held = {x: sum(c.values()) + 0.5 * len(seen) + 0.005 * ((1 << bits) - len(seen)) for x, c in counts.items()}
    out = []
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            out.append((i, "und", 0.0))
            continue
        score = {x: np.log(numbers[x] / sum(numbers.values())) + sum(np.log((counts[x].get(b, 0) + 0.5) / held[x]) for b in buckets(t) if b in seen) for x in counts}
        best = max(sorted(score), key=score.get)
        out.append((i, best, 1 / sum(np.exp(s - score[best]) for s in score.values())))
    return out


def test_language_equals_a_plain_one(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(lang := rng.choice(list(SYLLABLES)), rng.randint(1, 12), rng), lang) for i in range(60)]
    rows += [(100, prose("aa", 6, rng) + prose("bb", 6, rng), None), (101, "\u0130\u00df \u65e5\u672c", "aa"), (102, "a", None), (103, None, "aa"), (104, "1 2", "bb"), (None, "ka ro", "cc")]
    docs = docs_of(rows)
    for piece in (5, 1 << 18):  # texts in pieces and whole
        monkeypatch.setattr(langid, "PIECE", piece)
        model = langid.train(docs)
        labels, scores = model.predict([t for _, t, _ in rows])
        for (_, lang, score), got, value in zip(plain_language(rows), labels, scores):
            assert got == lang and abs(value - score) < 1e-4  # weights are single precision
        alone = [model.predict([t])[1][0] for _, t, _ in rows]
        assert alone == scores.tolist()  # neighbours change nothing


def test_language_without_labels_or_rows(spark, docs_of):
    docs = docs_of([(1, "some text", None), (2, None, "aa")])
    model = langid.train(docs)
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_language_training_sees_no_held_out_row(spark, docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert langid.train(docs_of([(held, "text", "aa")])).languages == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_spans(text):
    def holds(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in BASE.items()}


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "@x.y", ".", "..", "-", " ", "+", "+1 (555) 010-2030", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0000255.1.1.1", "é", "12", "7", "_%", "(", ")", "a@b@c.com", "x@a.b@c.d"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("a" * 200_000, "1" * 200_000, "+1" * 50_000, "@" * 100_000, "a@" * 50_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(text)  # linear, so these end


def test_bootstrap_finds_what_keeps_known_company(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, f"{prose('aa', 5, rng)} please write to {i}.x@mail.example.com today {prose('bb', 4, rng)}") for i in range(40)]
    rows += [(100, "please write to zed9.y@localhost today"), (101, "nothing of 12345678 that kind"), (102, None), (103, ""), (104, "é 10.0.0.1"), (7, rows[7][1])]
    docs = docs_of(rows)
    got = {}
    for r in pii.find(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert got[100]["spans"].startswith("email:16:") and got[100]["n_email"] == 0
    assert got[101]["spans"] == "" and got[102]["spans"] == "" and got[104]["spans"] == "ip:2:10"
    for i, text in rows:
        base = [f"{k}:{a}:{b}" for k, spans in plain_spans(text or "").items() for a, b in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(got[i]["spans"].split(","))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[0].count("<email>") == 1 and "@" not in masked[0] and masked[102] is None and masked[101] == rows[41][1] and masked[100] == "please write to <email> today"
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs).columns == docs.columns


def test_shards(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 200)) for i in range(600)] + [(1000, None), (1001, ""), (None, "abc"), (1002, "y" * 3000), *[(77, "z" * 100)] * 30]
    docs = docs_of(rows)
    out = sharding.assign(docs, 2000, round_bits=4).collect()
    assert len(out) == len(rows) and sum(r["n_bytes"] for r in out) == sum(len(t or "") for _, t in rows)
    held, members = {}, {}
    for r in out:
        held[r["shard"]] = held.get(r["shard"], 0) + r["n_bytes"]
        members.setdefault(r["shard"], []).append(r)
    for shard, size in held.items():
        assert size <= 2000 or len(members[shard]) == 1
    place = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows if i is not None}
    for r in out:
        if r["doc_id"] is not None and r["depth"]:
            assert r["shard"].split("+")[0] == format(place[r["doc_id"]], "060b")[: r["depth"]]
    # A bucket was split only because its parent was too large.
    sizes = [(place[i] if i is not None else int(hashlib.md5(b"").hexdigest()[:15], 16), len(t or "")) for i, t in rows]
    for r in out:
        if r["depth"] and r["doc_id"] is not None:
            parent = place[r["doc_id"]] >> (61 - r["depth"])
            assert sum(n for p, n in sizes if p >> (61 - r["depth"]) == parent) > 2000
    assert sharding.assign(docs, 10**9).select("shard").distinct().collect()[0][0] == "-"
    assert sharding.assign(docs.limit(0), 100).count() == 0


def test_write_shards(spark, docs_of, tmp_path):
    docs = docs_of([(i, "x" * 50) for i in range(100)] + [(7, "y" * 50), (7, "y" * 50), (None, "z"), (None, None)] + [(9, "w" * 100)] * 20)
    sharding.write_shards(docs, 500, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.drop("__shard").collect())) == sorted(map(str, docs.collect()))
    assert back.groupBy("__shard").agg(F.sum(F.length("text")).alias("n")).where("n > 500").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    held = {i: (centres[i % 30] + 0.3 * rng.normal(size=8)).astype(np.float32) for i in range(1500)}
    for i in range(700, 1000):
        held[i] = held[700]  # one common vector
    rows = [(i, v.tolist(), 0) for i, v in held.items()]
    rows += [(40, held[40].tolist(), 1), (2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] + [1.0] * 7, 0), (2060, [float("inf")] * 8, 0), (2080, [1.0, None] + [1.0] * 6, 0), (2100, [1.0] * 3, 0), (None, [1.0] * 8, 0), (3, held[3].tolist(), 1)]
    got = {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*held, 3, 40])
    table = np.array([held[i] for i in ids], dtype=np.float64)
    hits = total = 0
    assert sorted(got) == [i for i in held if i % 20 == 0]
    for q, found in got.items():
        found.sort()
        score = table @ table[q]
        order = [k for k in np.lexsort((ids, -np.round(score, 12))) if ids[k] != q][:20]
        assert [rank for rank, _, _ in found] == list(range(1, 21)) and all(i != q for _, i, _ in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({int(ids[k]) for k in order} & {i for _, i, _ in found})
        total += len({int(ids[k]) for k in order})
    assert hits >= 0.9 * total


def test_clustered_vectors_need_few_leaves():
    """Recall over 0.9 from less than a third of the leaves, at two sizes; lengths differ."""
    for n in (4_000, 16_000):
        rng = np.random.default_rng(8)
        centres = rng.normal(size=(200, 16))
        rows = (centres[rng.integers(200, size=n)] + 0.25 * rng.normal(size=(n, 16))) * rng.uniform(0.5, 1.5, size=(n, 1))
        tree = ann.Tree(rows[: n // 2], 24)
        leaf = tree.assign(rows)
        found = 0
        for q in range(0, n, n // 50):
            score = rows @ rows[q]
            score[q] = -np.inf
            near = np.argsort(-score)[:20]
            found += np.isin(leaf[near], tree.ranked(rows[q], tree.leaves // 4)).sum()
        assert tree.leaves > 60 and found >= 0.9 * 20 * 50


def test_visits_go_on_until_enough_rows_are_met(spark):
    rng = np.random.default_rng(9)
    tree = ann.Tree(rng.normal(size=(500, 4)), 5)
    sizes = np.ones(tree.leaves, dtype=np.int64)
    assert len(tree.ranked(np.ones(4), 2)) == 2 and len(tree.ranked(np.ones(4), 2, sizes, 21)) == 21
    far = [(i, [100.0 + i, 0.0], 0) for i in range(3)] + [(20 + i, [0.0, 1.0 + 0.001 * i], 0) for i in range(300)]
    got = ann.search(vectors(spark, far), F.col("vec_id") == 0, recall=0.01).groupBy("query_id").count().collect()
    assert [(r["query_id"], r["count"]) for r in got] == [(0, 20)]


def test_few_or_no_neighbours(spark):
    assert ann.search(vectors(spark, [(0, [1.0, 2.0], 0)]), F.col("vec_id") % 20 == 0).count() == 0
    got = ann.search(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]), F.col("vec_id") % 20 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 5.0), (2, 2, 5.0)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
