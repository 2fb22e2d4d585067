"""The pipeline against a plain version of each stage, and its contract."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_dedup import WHITE
from test_models import plain_spans, prose
from test_near_copies import brute_groups


def plain(rows, tokenizer):
    """(doc_id, piece, start, length, crc) of what stays."""
    rows = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    best = {}
    for i, t in rows:
        body = "".join(c for c in t if c not in WHITE)
        best[body] = min(best.get(body, (0, i, t)), (-len(t), i, t))
    rows = [(i, t) for _, i, t in best.values()]
    out = set()
    for (i, t), least in zip(rows, brute_groups(rows)):  # a Jaccard similarity of 0.8 or more
        if least != i:
            continue
        masked, at = "", 0
        for a, b, kind in sorted((a, b, k) for k, spans in plain_spans(t).items() for a, b in spans):
            if a >= at:
                masked += t[at:a] + f"<{kind}>"
            at = max(at, b)
        ids = tokenizer.encode(masked + t[at:], add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        out |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    return out


def test_pipeline_against_plain_stages(spark, docs_of, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    rows = [(i, prose("aa" if i % 3 else "bb", rng.choice([20, 200, 2500]), rng), "aa" if i % 3 else "bb") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n", 3), rows[i][2]) for i in range(10)]  # equal but for white space
    rows += [(200 + i, rows[i][1] + " added", rows[i][2]) for i in range(10)]
    rows += [(220 + i, " ".join("x" if k % 60 == 9 else w for k, w in enumerate(rows[i][1].split(" "))), rows[i][2]) for i in range(30)]  # edited copies
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 34 !!", "aa"), (303, f"{prose('aa', 9, rng)} write to a.b@example.com or +1 (555) 010-2030", "aa")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out}
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)
    assert got == plain(rows, Tokenizer.from_file(vocabulary)) and len(got) == len(out)
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024


def test_stages_keep_the_columns_of_documents(spark, docs_of):
    docs = docs_of([(1, "some text of words", "aa"), (2, None, None), (3, "some text of words", "aa"), (3, "some text of words", "aa"), (None, "some text of words", "aa"), (None, None, "aa")])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "unused")
        assert now.columns == docs.columns
    assert [r["doc_id"] for r in now.collect()] == [1]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0
