import hashlib
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, packing

PIECES = ["'s", "s", "'ll", " ", "  ", "\t", "\n", "\r\n", "\u0085", "\u00a0", "\u2028", "\u3000", "é", "ñ", "ß", "日本", "€", "😀", "a", "the", "12", "!", "?!", "<|endoftext|>", "don't", "_", "\x1c", "'S", "\u200b", "x" * 40]
AWKWARD = [None, "", " ", "a", "it's  'tis\t\tx", "<|endoftext|>a", "word " * 3000, "é" * 70, "日本語" * 50, "no-cut" + "b" * 5000]


def reference(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_same_ids_and_texts_as_the_library(vocabulary):
    library, codec = reference(vocabulary), bpe.ForcedBoundaryCodec(vocabulary, cache_entries=50)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=12).map("".join).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), max_size=4))
    def check(texts):
        ids = codec.encode_batch([t.encode() for t in texts])
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [list(i) for i in ids] == expected
        assert codec.decode_batch(ids) == [library.decode(e, skip_special_tokens=False) for e in expected]

    check()


def test_more_fragments_than_slots(vocabulary, monkeypatch):
    """One text with more different fragments than the table has slots, and more bytes than the cache holds."""
    monkeypatch.setattr(bpe, "SLOT_BITS", 6)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    library, codec = reference(vocabulary), bpe.ForcedBoundaryCodec(vocabulary)
    text = " ".join(f"w{i}x {'y' * (i % 40)}{i}" for i in range(3000))
    for _ in range(2):
        assert list(codec.encode_batch([text.encode(), b"a b"])[0]) == library.encode(text, add_special_tokens=False).ids
    codec.encode_batch([b"a b"])
    assert len(codec._decimal) < 10  # started anew


def test_decoding_keeps_broken_characters_like_the_library(vocabulary):
    library, codec = reference(vocabulary), bpe.codec(vocabulary)
    ids = library.encode("日本€").ids
    for cut in (ids[:1], ids[1:], ids[::2]):
        assert codec.decode_batch([np.array(cut)]) == [library.decode(cut, skip_special_tokens=False)]


def test_tables(spark, docs_of, vocabulary):
    library = reference(vocabulary)
    docs = docs_of([(i, t) for i, t in enumerate(AWKWARD)] + [(1, ""), (None, "x")])
    digest = {r["doc_id"]: r for r in bpe.round_trip_digest(docs, vocabulary).collect()}
    encoded = bpe.encode_table(docs, vocabulary)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_table(encoded, vocabulary).collect()}
    for i, t in enumerate(AWKWARD):
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == expected and texts[i] == (t or "") and digest[i]["n_tokens"] == len(expected)
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digest(docs, vocabulary).count() == len(AWKWARD) + 2
    assert bpe.round_trip_digest(docs.limit(0), vocabulary).count() == 0


@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 8))
def test_bins(sizes, limit):
    bins, held = packing.OpenBins(20, limit), defaultdict(int)
    for size in sizes:
        number, offset = bins.place(size)
        assert offset == held[number]
        held[number] += size
        assert held[number] <= 20
    assert dict(bins.left()) == {n: held[n] for n, _ in bins.left()} and len(bins.left()) <= limit


def test_best_fit_takes_the_fullest_that_fits():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert bins.place(9) == (2, 0) and bins.place(7) == (3, 0)  # the fullest open one closes
    assert bins.place(5) == (1, 5)


def test_cut():
    assert packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_packing(spark, docs_of, vocabulary):
    library = reference(vocabulary)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(100 + i, "word " * (i * 37 % 300)) for i in range(300)] + [(5, "again"), (None, "x")]
    out = packing.pack(docs_of(rows, 5), vocabulary, capacity=64, open_bins=4).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"] <= 64
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] not in (5, None):
            pieces[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in rows:
        if i not in (5, None):
            own = sorted(pieces[i])
            expected = library.encode(t or "", add_special_tokens=False).ids + [2]
            assert [x for _, _, ids in own for x in ids] == expected
            assert [p for p, _, _ in own] == list(range(len(own))) and len(own) == -(-len(expected) // 64)
    total = sum(r["length"] for r in out)
    assert len(used) <= 1.1 * total / 64 + 2
    assert packing.pack(docs_of(rows).limit(0), vocabulary).count() == 0
