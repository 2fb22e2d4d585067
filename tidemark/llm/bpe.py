"""Byte-pair encoding by forced boundaries, and decoding.

A merge can only join bytes that stand side by side inside some vocabulary token. Where two neighbouring bytes of a
text never do so in any token, no merge crosses, so the text may be cut there and the fragments encoded on their own;
the concatenated ids are those of the whole text. Fragments repeat a lot (a word with its leading space, a
punctuation mark), so each distinct one is encoded once per worker and looked up afterwards.

Two more conditions keep the pre-tokenizer's view unchanged by a cut: it is never made after white space (a run of
white space gives its last character to the next word, which the run's end would hide) nor before an apostrophe (a
contraction is only recognised at the start of a piece, which a cut would fake), and only between whole characters.

Null and empty texts give no ids. The special token's string inside a text gives its special id, as the tokenizers
library does; such a text takes the library's own path whole. Rows are independent: ties, repeats and further
columns do not matter, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_slices, texts

#: ASCII white space, and the byte pairs that end a longer white-space character in UTF-8.
ASCII_SPACE = (*range(0x09, 0x0E), *range(0x1C, 0x21))
WIDE_SPACE_ENDS = (
    (0xC2, 0x85),
    (0xC2, 0xA0),
    (0x9A, 0x80),
    *((0x80, b) for b in range(0x80, 0x8B)),
    (0x80, 0xA8),
    (0x80, 0xA9),
    (0x80, 0xAF),
    (0x81, 0x9F),
)
#: Fragments and bytes (theirs, their ids' and their decimals') kept by a worker before it starts anew, slots of their table at first, and the longest fragment kept by its bytes.
CACHE_ENTRIES, CACHE_BYTES, SLOT_BITS, SHORT = 300_000, 32 << 20, 19, 23
#: Masks that keep the first n bytes of a little-endian word; odd multipliers that spread keys over slots.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class ForcedBoundaryCodec:
    """Encodes and decodes batches of UTF-8 texts with one vocabulary file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        added = {t.content.encode(): i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self.special = added
        alphabet = _byte_alphabet()
        tokens = {}
        for token, i in self._tokenizer.get_vocab().items():
            raw = token.encode()
            tokens[i] = raw if raw in added else bytes(alphabet[c] for c in token)
        inside = np.zeros((256, 256), dtype=bool)
        for i, raw in tokens.items():
            if raw not in added and len(raw) > 1:
                b = np.frombuffer(raw, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        forced = ~inside
        forced[list(ASCII_SPACE), :] = False
        forced[:, ord("'")] = False
        forced[:, 0x80:0xC0] = False
        self._forced = forced.ravel()
        wide = np.zeros((256, 256), dtype=bool)
        for a, b in WIDE_SPACE_ENDS:
            wide[a, b] = True
        self._wide = wide.ravel()
        size = max(tokens) + 1
        raws = [tokens.get(i, b"") for i in range(size)]
        self._raw_len = np.array([len(r) for r in raws], dtype=np.int64)
        self._raw_start = np.concatenate([[0], np.cumsum(self._raw_len)[:-1]])
        self._raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self._cache_entries = cache_entries
        self._reset()

    def _reset(self) -> None:
        self._long: dict[bytes, int] = {}
        self._decimal: list[bytes | None] = []  # written when first asked for
        self._keys = np.zeros((3, 1024), dtype=np.uint64)
        self._starts = np.zeros(1024, dtype=np.int64)
        self._lengths = np.zeros(1024, dtype=np.int64)
        self._ids = np.zeros(4096, dtype=np.int32)
        self._used = 0
        self._held = 0  # bytes
        self._slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)

    def boundaries(self, buffer: np.ndarray) -> np.ndarray:
        """Positions p such that a cut between bytes p - 1 and p is certain."""
        if len(buffer) < 2:
            return np.zeros(0, dtype=np.int64)
        pairs = buffer[:-1].astype(np.uint16) << 8
        pairs |= buffer[1:]
        cut = self._forced[pairs]
        if len(buffer) > 2 and (buffer >= 0xC2).any():
            cut[1:] &= ~self._wide[pairs[:-1]]
        return np.flatnonzero(cut) + 1

    def _learn(self, missing: list[bytes]) -> np.ndarray:
        """Encode new fragments with the library and keep them; return their numbers."""
        encoded = self._tokenizer.encode_batch_fast([m.decode("utf-8") for m in missing], add_special_tokens=False)
        first = len(self._decimal)
        while first + len(missing) > len(self._starts):
            self._starts, self._lengths = (np.resize(x, 2 * len(x)) for x in (self._starts, self._lengths))
            self._keys = np.concatenate([self._keys, self._keys], axis=1)
        for k, e in enumerate(encoded, first):
            ids = e.ids
            n = len(ids)
            while self._used + n > len(self._ids):
                self._ids = np.resize(self._ids, 2 * len(self._ids))
            self._ids[self._used : self._used + n] = ids
            self._starts[k], self._lengths[k] = self._used, n
            self._used += n
        self._held += sum(map(len, missing)) + 12 * (self._used - int(self._starts[first])) if missing else 0
        self._decimal += [None] * len(missing)
        return np.arange(first, first + len(missing))

    def _lookup(self, keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Numbers of the fragments with these keys; -1 where unknown. ``slot`` is moved to where each search ended."""
        found = np.full(keys.shape[1], -1, dtype=np.int64)
        todo = np.arange(keys.shape[1])
        while len(todo):
            entry = self._slots[slot[todo]]
            same = entry >= 0
            for mine, theirs in zip(keys, self._keys):
                same &= theirs[entry] == mine[todo]
            found[todo[same]] = entry[same]
            todo = todo[~same & (entry >= 0)]
            slot[todo] = (slot[todo] + 1) & (len(self._slots) - 1)
        return found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for each key starts."""
        bits = len(self._slots).bit_length() - 1
        return ((keys[0] * MIX[0] ^ keys[1] * MIX[1] ^ (keys[2] * MIX[2] >> np.uint64(7))) * MIX[0] >> np.uint64(64 - bits)).astype(np.int64)

    def _place(self, numbers: np.ndarray) -> None:
        """Enter fragments by their keys; the table doubles before it is half full."""
        if 2 * len(self._decimal) > len(self._slots):
            known = self._slots[self._slots >= 0]
            self._slots = np.full(1 << (2 * len(self._decimal)).bit_length(), -1, dtype=np.int32)
            numbers = np.concatenate([known, numbers])
        for number, s in zip(numbers.tolist(), self._slot(self._keys[:, numbers]).tolist()):
            while self._slots[s] >= 0:
                s = (s + 1) & (len(self._slots) - 1)
            self._slots[s] = number

    def _fragments(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each fragment of the batch, and where each document's fragments start (one more at the end)."""
        joined = b"".join(docs)
        buffer = np.frombuffer(joined + bytes(24), dtype=np.uint8)
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        mark = np.zeros(len(joined) + 1, dtype=bool)
        mark[0] = True
        mark[ends] = True
        mark[self.boundaries(buffer[: len(joined)])] = True
        cuts = np.flatnonzero(mark)
        starts, sizes = cuts[:-1], np.diff(cuts)
        if len(self._decimal) > self._cache_entries or self._held > CACHE_BYTES:
            self._reset()
        # A short fragment's key is its own bytes and its length, so equal keys mean equal fragments.
        words = np.lib.stride_tricks.as_strided(buffer, (len(joined) + 1, 24), (1, 1))[starts].view(np.uint64).reshape(-1, 3).T
        held = np.minimum(sizes, SHORT)
        keys = np.stack([w & KEEP[np.clip(held - 8 * i, 0, 8)] for i, w in enumerate(words)])
        keys[2] |= held.astype(np.uint64) << np.uint64(56)
        index = np.full(len(starts), -1, dtype=np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        index[short] = self._lookup(keys[:, short], self._slot(keys[:, short]))
        unknown = short[index[short] < 0]
        if len(unknown):
            new: dict[bytes, int] = {}
            own = [new.setdefault(joined[a:b], len(new)) for a, b in zip(starts[unknown].tolist(), cuts[unknown + 1].tolist())]
            numbers = self._learn(list(new))
            own = np.array(own)
            index[unknown] = numbers[own]
            first = unknown[np.unique(own, return_index=True)[1]]
            self._keys[:, numbers] = keys[:, first]
            self._place(numbers)
        long = np.flatnonzero(sizes > SHORT)
        if len(long):
            pieces = [joined[a:b] for a, b in zip(starts[long].tolist(), cuts[long + 1].tolist())]
            if missing := [p for p in dict.fromkeys(pieces) if p not in self._long]:
                self._long.update(zip(missing, self._learn(missing).tolist()))
            index[long] = [self._long[p] for p in pieces]
        return index, np.concatenate([[0], np.searchsorted(cuts, ends)])

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self._lengths[index]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        return self._ids[np.repeat(self._starts[index] - before, lengths) + np.arange(total)], lengths

    def _decimals(self, index: np.ndarray) -> list[bytes]:
        """Decimal ids, joined by commas, of each fragment."""
        said = self._decimal
        for i in np.unique(index).tolist():
            if said[i] is None:
                start = self._starts[i]
                said[i] = b",".join(b"%d" % x for x in self._ids[start : start + self._lengths[i]].tolist())
        return [said[i] for i in index.tolist()]

    def encode_batch(self, docs: list[bytes]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        return [ids for ids, _ in self.encode_digest(docs, decimal=False)]

    def encode_digest(self, docs: list[bytes], decimal: bool = True) -> list[tuple[np.ndarray, bytes]]:
        """Ids of each text and, if asked for, the same ids as decimals joined by commas."""
        whole = {i for i, d in enumerate(docs) if any(s in d for s in self.special)}
        plain = [b"" if i in whole else d for i, d in enumerate(docs)]
        index, at = self._fragments(plain)
        ids, lengths = self._gather(index)
        upto = np.concatenate([[0], np.cumsum(lengths)])[at]
        said = self._decimals(index) if decimal else []
        out = []
        for i, doc in enumerate(docs):
            if i in whole:
                own = self._tokenizer.encode(doc.decode("utf-8"), add_special_tokens=False).ids
                out.append((np.array(own, dtype=np.int32), b",".join(b"%d" % x for x in own) if decimal else b""))
            else:
                out.append((ids[upto[i] : upto[i + 1]], b",".join(said[at[i] : at[i + 1]]) if decimal else b""))
        return out

    def decode_batch(self, docs: list[np.ndarray]) -> list[str]:
        """Texts of the given id arrays, special tokens kept; invalid UTF-8 becomes U+FFFD."""
        if not docs:
            return []
        ids = np.concatenate(docs)
        lengths = self._raw_len[ids]
        before = np.cumsum(lengths) - lengths
        raw = self._raw[np.repeat(self._raw_start[ids] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()
        at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum([len(d) for d in docs])])].tolist()
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(at, at[1:])]


_CODECS: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One codec per worker and vocabulary, so that its fragments are kept from batch to batch and task to task."""
    if path not in _CODECS:
        # Every core has a worker already; threads in each would cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODECS[path] = ForcedBoundaryCodec(path)
    return _CODECS[path]


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every text; null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches):
            ids = own.encode_batch(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` for every array of ids; null gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.array(v or [], dtype=np.int64) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode_batch(ids), pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text; return ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches):
            encoded = own.encode_digest(texts(batch))
            decoded = own.decode_batch([ids for ids, _ in encoded])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids, _ in encoded], pa.int64()),
                    pa.array([hashlib.sha256(said).hexdigest() for _, said in encoded]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
