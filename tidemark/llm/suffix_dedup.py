"""Repeated passages by a sparse suffix array: bytes covered by a string that also starts in an earlier document.

Only strings of ``length`` bytes matter, so the suffixes are taken at those starts; and a string can only repeat if a
part of it does. Each window of ``length`` bytes is represented by its anchor, the n-gram inside it with the least
hash: equal windows have equal anchors at equal places. A maximal run of windows with one anchor is a phrase. So this
is not a suffix array over every byte: suffixes whose anchor no other document has are never sorted, and what ranges
are cut by is the anchor's leading bytes, not the suffix's. The results are those of the full array.

1. Documents are dealt into chunks, which bound memory and combine before every shuffle. A chunk sends out the hashes
   of its anchors, packed, to buckets by hash; a bucket answers which of them other documents have too, and which of
   these have more than ``HOT_BYTES`` of phrases.
2. For those anchors the chunk sends each distinct phrase once, with the smallest and greatest id that has it, to a
   range bucket: sampled splitters part the anchors by all their bytes (and a hash parts each range further where more
   buckets are needed than splitters are kept). Equal anchors are never parted, so strings on two sides of a boundary
   differ within their anchor, which settles the comparison across it. A hot anchor, say of a line that a third of all
   documents hold, would fill a bucket: its windows go one by one, dealt by a hash of all their bytes. Equal windows
   meet, and a chunk sends each once for each phrase, so nothing but copies can pile up.
3. A bucket sorts the suffixes at all its windows by multikey quicksort (a character is eight bytes; each round sorts
   only what is still tied) and compares neighbours: a run of equals takes the smallest id in it.
4. The chunk gets back, per phrase, the smallest id for each stretch of windows, and marks in each of its documents
   what a smaller id has too. Hashes choose candidates and name phrases inside one chunk, where bytes confirm them;
   equality is always of whole bytes.

One exchange of the texts serves all steps. Null texts count as empty. Null ids count as greater than all others, and
rows with equal ids never remove from each other. Texts shorter than ``length`` stay whole. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 24
STEP = 1 << 19
#: Bounds of a chunk's text, the number of chunks aimed at between them, and the text behind one bucket.
CHUNK_BYTES, CHUNKS, BUCKET_BYTES = (2 << 20, 24 << 20), 192, 8 << 20
#: Bytes of phrases from which an anchor is hot; splitters kept at most, anchors drawn for each, and the bytes of a drawn slice.
HOT_BYTES, MAX_SPLITTERS, SAMPLED, SLICE = 2 << 20, 1 << 16, 16, 1 << 16
LAST = np.iinfo(np.int64).max
#: Odd multipliers.
M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= M[0]
    h ^= h >> np.uint64(29)
    return h


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, first byte highest; ``buffer`` ends in eight spare bytes."""
    return np.lib.stride_tricks.as_strided(buffer, (len(buffer) - 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


class Chunk:
    """Texts side by side in one buffer, with the ids and bounds of the documents."""

    def __init__(self, rows: pa.Table):
        # The same order whatever the shuffle's: runs are cut at fixed places of the buffer.
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = rows.column("doc_id").combine_chunks().cast(pa.int64())
        self.rows = rows.column("doc_id")
        self.ids = pc.fill_null(ids, LAST).to_numpy(zero_copy_only=False)
        text = pc.fill_null(rows.column("text").combine_chunks().cast(pa.large_binary()), b"")
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, dtype=np.int64)
        data = text.buffers()[2] if len(text) else None
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        self.size = len(raw)
        self.bounds = offsets - offsets[0]
        self.buffer = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])


class Runs(NamedTuple):
    start: np.ndarray  # first window of the run, in the chunk's buffer
    count: np.ndarray  # windows
    anchor: np.ndarray
    gram: np.ndarray  # the anchor's hash
    lead: np.ndarray  # the anchor's first eight bytes
    names: tuple[np.ndarray, np.ndarray]  # 128 bits that name the phrase


def find_runs(chunk: Chunk, length: int = LENGTH, gram: int = GRAM) -> Runs:
    """Runs of windows with one anchor; no window leaves its document."""
    if chunk.size < length:
        empty = np.zeros(0, dtype=np.int64)
        none = empty.astype(np.uint64)
        return Runs(empty, empty, empty, none, none, (none, none))
    inside = np.zeros(chunk.size + 1, dtype=np.int32)
    starts, ends = chunk.bounds[:-1], chunk.bounds[1:]
    np.add.at(inside, np.maximum(starts, ends - length + 1), 1)
    np.add.at(inside, ends, -1)
    valid = np.cumsum(inside[:-1]) == 0
    found = [_slice_runs(chunk.buffer, a, min(a + STEP, chunk.size - length + 1), valid, length, gram) for a in range(0, chunk.size - length + 1, STEP)]
    parts = [np.concatenate(p) for p in zip(*found)]
    return Runs(*parts[:5], (parts[5], parts[6]))


def _slice_runs(buffer: np.ndarray, low: int, high: int, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs among the windows that start in [low, high)."""
    words = _words(buffer[low : high + length + 15])
    grams = high - low + length - gram
    hashes = words[:grams] * M[1]
    for k in range(8, gram - 7, 8):
        hashes += words[k : k + grams] * M[1 + k // 8]
    if gram % 8:
        hashes += words[gram - 8 : gram - 8 + grams] * M[5]
    hashes = _mix(hashes)
    place = np.uint64((1 << 20) - 1)
    least = (hashes & ~place) | np.arange(grams, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: high - low], least[width - have : width - have + high - low])
    ok = valid[low:high]
    changes = np.ones(high - low + 1, dtype=bool)
    changes[1:-1] = least[1:] != least[:-1]
    edge = np.concatenate([[False], ok, [False]])
    start = np.flatnonzero(ok & (changes[:-1] | ~edge[:-2]))
    end = np.flatnonzero(ok & (changes[1:] | ~edge[2:]))
    anchor = (least[start] & place).astype(np.int64)
    names = []
    for salt in (0, 3):
        name = (end - start).astype(np.uint64) * M[salt]
        for at, turn in ((start, 0), (end, 1)):
            for i, k in enumerate((*range(0, length - 8, 8), length - 8)):
                name = (name ^ words[at + k]) * M[(i + salt + turn) % 7]
                name ^= name >> np.uint64(31)
        names.append(name)
    return start + low, end - start + 1, anchor + low, hashes[anchor], words[anchor], *names


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, and where in it each group of equals starts."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _doc_ids(chunk: Chunk, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.searchsorted(chunk.bounds, start, side="right") - 1
    return row, chunk.ids[row]


def _phrases(chunk: Chunk, runs: Runs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase number of each run, an order of the runs by phrase, and each phrase's first place in it."""
    order, first = _grouped(*runs.names)
    if len(first) and not _confirmed(chunk.buffer, runs, order, first, length):
        # Two phrases of one name: tell all phrases apart by their bytes.
        texts = [chunk.buffer[a : a + n].tobytes() for a, n in zip(runs.start.tolist(), (runs.count + length - 1).tolist())]
        numbers: dict[bytes, int] = {}
        order, first = _grouped(np.array([numbers.setdefault(t, len(numbers)) for t in texts], dtype=np.int64))
    number = np.zeros(len(order), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return number, order, first


def _confirmed(buffer: np.ndarray, runs: Runs, order: np.ndarray, first: np.ndarray, length: int) -> bool:
    """Whether the runs of each name have the same bytes as the first of them."""
    sizes = np.diff(np.append(first, len(order)))
    many = np.repeat(sizes > 1, sizes)
    this, that = order[many], np.repeat(order[first], sizes)[many]
    if not len(this):
        return True
    if (runs.count[this] != runs.count[that]).any():
        return False
    long = runs.count[this] + length - 1
    for at in range(0, int(long.max()), 8):
        place = np.minimum(at, long - 8)  # the last eight bytes overlap
        a, b = runs.start[this] + place, runs.start[that] + place
        for k in range(8):
            if (buffer[a + k] != buffer[b + k]).any():
                return False
    return True


def _keys(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place as strings that sort like them (but for trailing zeros, which tie)."""
    if not len(at):
        return np.zeros(0, dtype=f"S{size}")
    return np.ascontiguousarray(buffer[at[:, None] + np.arange(size)]).view(f"S{size}").ravel()


def multikey_groups(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Group number of the suffix at each place, equal where ``group`` and the first ``length`` bytes are.

    Multikey quicksort, a character being eight bytes: round by round, what is still tied is sorted by its next one.
    ``group`` is what is known to differ before the first round.
    """
    words = _words(buffer)
    order, first = _grouped(group)
    group = np.zeros(len(at), dtype=np.int64)
    sizes = np.diff(np.append(first, len(order)))
    group[order] = np.repeat(first, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    for k in (*range(0, length - 8, 8), length - 8):
        if not len(tied):
            break
        order, first = _grouped(group[tied], words[at[tied] + k])
        sizes = np.diff(np.append(first, len(order)))
        old = group[tied[order]][first]
        # A part's number: its group's number plus what sorts before it in the group.
        same = np.concatenate([[False], old[1:] == old[:-1]])
        begin = np.maximum.accumulate(np.where(same, 0, first))
        group[tied[order]] = np.repeat(old + first - begin, sizes)
        tied = tied[order][np.repeat(sizes > 1, sizes)]
    return group


class Stretches(NamedTuple):
    """Stretches of windows of distinct phrases, by phrase, that have one smallest id."""

    phrase: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray


def _stretches(buffer: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, low: np.ndarray, length: int, gram: int) -> Stretches:
    """Sort the suffixes at all windows of distinct phrases and compare neighbours.

    Equal windows have equal anchors at equal places, so a phrase whose anchor no other has is settled at once, and
    the others are sorted within (anchor, place of the anchor in the window).
    """
    words = _words(buffer)
    at = start + anchor
    order, first = _grouped(*(words[at + k] for k in (*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else []))))
    sizes = np.diff(np.append(first, len(order)))
    family = np.zeros(len(start), dtype=np.int64)
    family[order] = np.repeat(np.arange(len(first)), sizes)
    many = np.flatnonzero((sizes > 1)[family])
    one = np.flatnonzero((sizes == 1)[family])
    of = np.repeat(many, count[many])
    window = np.arange(len(of)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    group = multikey_groups(buffer, start[of] + window, family[of] * length + anchor[of] - window, length)
    order, first = _grouped(group)
    least = np.zeros(len(of), dtype=np.int64)
    if len(first):
        least[order] = np.repeat(np.minimum.reduceat(low[of][order], first), np.diff(np.append(first, len(order))))
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(of)) - 1
    phrase = np.concatenate([one, of[begin]])
    by = np.argsort(phrase, kind="stable")
    parts = (phrase, np.concatenate([np.zeros(len(one), dtype=np.int64), window[begin]]), np.concatenate([count[one] - 1, window[stop] if len(of) else begin]), np.concatenate([low[one], least[begin]]))
    return Stretches(*(p[by] for p in parts))


def _expand(number: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with ``number[i] == keys[j]``; ``keys`` is sorted."""
    begin, end = np.searchsorted(keys, number, side="left"), np.searchsorted(keys, number, side="right")
    sizes = end - begin
    return np.repeat(np.arange(len(number)), sizes), np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _binary(values: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([v if isinstance(v, bytes) else v.tobytes() for v in values], pa.binary())


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _cut(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else []
    return [(int(sorted_keys[a]), int(a), int(b)) for a, b in zip(first, [*first[1:], len(sorted_keys)])]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, ``kept`` (the remaining bytes)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunk_bytes = min(max(total // CHUNKS, CHUNK_BYTES[0]), CHUNK_BYTES[1])
    chunks, buckets = int(total // chunk_bytes + 1), int(total // BUCKET_BYTES + 8)
    ranges = min(buckets, MAX_SPLITTERS)
    parts_of_range = -(-buckets // ranges)
    splitters = _splitters(docs, total, ranges, length, gram)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int"))

    def sketch(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        runs = find_runs(chunk, length, gram)
        _, ids = _doc_ids(chunk, runs.start)
        order, phrase = _grouped(runs.gram, runs.names[0])
        grams, begin = np.unique(runs.gram[order][phrase], return_index=True)
        first = phrase[begin]
        many, size = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint8)
        if len(first):
            many = np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
            size = np.ceil(np.log2(np.add.reduceat(runs.count[order][phrase] + length - 1, begin))).astype(np.uint8)
        bucket = (grams >> np.uint64(32)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        parts = _cut(bucket[by])
        return pa.table({
            "bucket": pa.array([k for k, _, _ in parts], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "grams": _binary([grams[by[a:b]].astype(np.uint32) for _, a, b in parts]),
            "many": _binary([np.packbits(many[by[a:b]]) for _, a, b in parts]),
            "size": _binary([size[by[a:b]] for _, a, b in parts]),
        })

    def shared(key: tuple, rows: pa.Table) -> pa.Table:
        grams = [np.frombuffer(g, dtype=np.uint32) for g in rows.column("grams").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(g)) for m, g in zip(rows.column("many").to_pylist(), grams)]).astype(bool)
        every = np.concatenate(grams)
        order, first = _grouped(every)
        sizes = np.diff(np.append(first, len(order)))
        hit, hot = np.zeros(len(every), dtype=bool), np.zeros(len(every), dtype=bool)
        if len(first):
            hit[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(many[order], first), sizes)
            held = np.exp2(_joined(rows.column("size"), "u1").astype(np.float64))
            hot[order] = np.repeat(np.add.reduceat(held[order], first) > HOT_BYTES, sizes)
        ends = np.cumsum([len(g) for g in grams])
        cuts = [(slice(e - len(g), e), g) for g, e in zip(grams, ends)]
        return pa.table({"bucket": rows.column("bucket"), "chunk": rows.column("chunk"), "grams": _binary([g[hit[c]] for c, g in cuts]), "hot": _binary([hot[c][hit[c]] for c, _ in cuts])})

    def send(key: tuple, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        runs = find_runs(chunk, length, gram)
        number, order, first = _phrases(chunk, runs, length)
        _, ids = _doc_ids(chunk, runs.start)
        low, high = (np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)) if len(first) else (ids, ids)
        one = order[first]  # a run that stands for its phrase
        asked = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(g, dtype=np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, g in zip(wanted.column("bucket").to_pylist(), wanted.column("grams").to_pylist()))])
        hot = asked[_joined(wanted.column("hot"), "?")]
        own = runs.gram[one]
        own = own & np.uint64(0xFFFFFFFF) | (own >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)
        is_hot = np.isin(own, hot)
        whole, cut = np.flatnonzero(np.isin(own, asked) & ~is_hot), np.flatnonzero(is_hot)
        # Phrases of other anchors go whole, those of hot ones window by window.
        windows = runs.count[one[cut]]
        phrase = np.concatenate([whole, np.repeat(cut, windows)])
        at = np.concatenate([np.zeros(len(whole), dtype=np.int64), np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)])
        count = np.concatenate([runs.count[one[whole]], np.ones(windows.sum(), dtype=np.int64)])
        start = runs.start[one[phrase]] + at
        anchor = runs.anchor[one[phrase]]
        raw = chunk.buffer
        n, to = len(whole), np.zeros(len(phrase), dtype=np.int64)
        to[:n] = np.searchsorted(splitters, _keys(raw, anchor[:n], gram), side="right") * parts_of_range + (runs.gram[one[whole]] % np.uint64(parts_of_range)).astype(np.int64)
        to[n:] = (_window_hash(raw, start[n:], length) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        parts = _cut(to[by])

        def text(i: np.ndarray) -> np.ndarray:
            sizes = count[i] + length - 1
            before = np.cumsum(sizes) - sizes
            return raw[np.repeat(start[i] - before, sizes) + np.arange(sizes.sum())]

        return pa.table({
            "bucket": pa.array([k for k, _, _ in parts], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "phrase": _binary([phrase[by[a:b]].astype(np.uint32) for _, a, b in parts]),
            "at": _binary([at[by[a:b]].astype(np.uint8) for _, a, b in parts]),
            "count": _binary([count[by[a:b]].astype(np.uint8) for _, a, b in parts]),
            "anchor": _binary([(anchor - start)[by[a:b]].astype(np.uint8) for _, a, b in parts]),
            "low": _binary([low[phrase[by[a:b]]] for _, a, b in parts]),
            "high": _binary([high[phrase[by[a:b]]] for _, a, b in parts]),
            "text": _binary([text(by[a:b]) for _, a, b in parts]),
        })

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        phrase, count = _joined(rows.column("phrase"), "u4"), _joined(rows.column("count"), "u1").astype(np.int64)
        anchor, at = (_joined(rows.column(c), "u1").astype(np.int64) for c in ("anchor", "at"))
        low, high = _joined(rows.column("low"), "i8"), _joined(rows.column("high"), "i8")
        text = b"".join(rows.column("text").to_pylist())
        sender = np.repeat(rows.column("chunk").to_numpy(), [len(p) // 4 for p in rows.column("phrase").to_pylist()])
        start = np.cumsum(count + length - 1) - (count + length - 1)
        # Phrases that several chunks sent are one; anchors follow from the text.
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(start.tolist(), (start + count + length - 1).tolist())], dtype=np.int64)
        order, first = _grouped(own)
        one = order[first]
        least = np.minimum.reduceat(low[order], first) if len(first) else low
        buffer = np.frombuffer(text + bytes(16), dtype=np.uint8)
        found = _stretches(buffer, start[one], count[one], anchor[one], least, length, gram)
        row, stretch = _expand(own, found.phrase)
        told = found.least[stretch] < high[row]
        row, stretch = row[told], stretch[told]
        by = np.argsort(sender[row], kind="stable")
        row, stretch = row[by], stretch[by]
        parts = _cut(sender[row])
        return pa.table({
            "chunk": pa.array([k for k, _, _ in parts], pa.int32()),
            "phrase": _binary([phrase[row[a:b]] for _, a, b in parts]),
            "from": _binary([(at[row[a:b]] + found.first[stretch[a:b]]).astype(np.uint8) for _, a, b in parts]),
            "to": _binary([(at[row[a:b]] + found.last[stretch[a:b]]).astype(np.uint8) for _, a, b in parts]),
            "least": _binary([found.least[stretch[a:b]] for _, a, b in parts]),
        })

    def mark(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        edges = np.zeros(chunk.size + 1, dtype=np.int32)
        if told.num_rows:
            runs = find_runs(chunk, length, gram)
            number, _, _ = _phrases(chunk, runs, length)
            _, ids = _doc_ids(chunk, runs.start)
            phrase = _joined(told.column("phrase"), "u4").astype(np.int64)
            by = np.argsort(phrase, kind="stable")
            phrase = phrase[by]
            first, last, least = (_joined(told.column(c), t)[by] for c, t in (("from", "u1"), ("to", "u1"), ("least", "i8")))
            run, stretch = _expand(number, phrase)
            gone = least[stretch] < ids[run]
            run, stretch = run[gone], stretch[gone]
            np.add.at(edges, runs.start[run] + first[stretch], 1)
            np.add.at(edges, runs.start[run] + last[stretch] + length, -1)
        removed = np.cumsum(edges[:-1]) > 0
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist()):
            gone = removed[a:b]
            kept = chunk.buffer[a:b][~gone].tobytes()
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (b > a and gone[0])))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        table = {"doc_id": chunk.rows, **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(table | ({"kept": pa.array(out["kept"], pa.binary())} if keep_text else {}))

    sketched = dealt.groupBy("chunk").applyInArrow(sketch, "bucket int, chunk int, grams binary, many binary, size binary")
    wanted = sketched.groupBy("bucket").applyInArrow(shared, "bucket int, chunk int, grams binary, hot binary")
    sent = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, phrase binary, at binary, count binary, anchor binary, low binary, high binary, text binary")
    told = sent.groupBy("bucket").applyInArrow(compare, "chunk int, phrase binary, `from` binary, `to` binary, least binary")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(mark, schema)


def _window_hash(buffer: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(length):
        h = (h ^ buffer[start + k]) * M[k % 7]
        h ^= h >> np.uint64(29)
    return _mix(h)


def _splitters(docs: DataFrame, total: int, ranges: int, length: int, gram: int) -> np.ndarray:
    """Bounds between ranges: quantiles of the anchors in a sample of slices, drawn from all of every text, that grows with their number."""
    slices = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / SLICE).cast("int"))).alias("slice"))
    share = min(1.0, ranges * SAMPLED * (length - gram) / max(1, total))
    drawn = slices.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "slice"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    cut = drawn.select("doc_id", F.substring("text", F.col("slice") * SLICE + 1, F.lit(SLICE)).alias("text"))

    def anchors(batches):
        for batch in batches:
            chunk = Chunk(pa.Table.from_batches([batch]))
            found = np.unique(_keys(chunk.buffer, find_runs(chunk, length, gram).anchor, gram))
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["anchors"])

    every = np.sort(np.concatenate([np.zeros(0, dtype=f"S{gram}"), *(np.frombuffer(r["anchors"], dtype=f"S{gram}") for r in cut.mapInArrow(anchors, "anchors binary").toLocalIterator())]))
    return np.unique(every[np.linspace(0, len(every) - 1, ranges + 1)[1:-1].astype(int)]) if len(every) else every


#: The same result from every window of every text: slow, but plain SQL.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS p, h FROM d WHERE n >= 50),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM s) WHERE least < doc_id),
edge AS (SELECT *, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span
         FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM edge GROUP BY doc_id, span),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT c.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
                string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h
         FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
