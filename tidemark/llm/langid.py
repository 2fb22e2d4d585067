"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors, over a bounded sample of labelled rows (``max_train_rows`` in
expectation, drawn by a hash of the id so that a re-run draws the same); the counts are summed by Spark and become one
matrix of log-probabilities, languages x buckets, whose size is fixed by ``bits`` and the number of languages. That
matrix is broadcast. A batch of texts is scored at once in numpy: n-gram buckets of all texts side by side, matrix
columns gathered and summed per text, no loop over characters. Very long texts go in pieces, which bounds memory, and
each text's sum is taken in its own order whatever stands beside it.

Null texts and texts without a letter get ``und`` and score 0. Empty tables give no rows; with no labelled row at all
every text gets ``und``. Ties go to the first language in order. Null ids are scored like others (and train, since the
held-out test is then unknown, never); so are repeated rows. Further columns are ignored. Neither id nor label nor source takes part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

ORDERS = (1, 2, 3)
BITS = 15
MAX_TRAIN_ROWS = 20_000
#: Characters scored at once.
PIECE = 1 << 18
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash, one for each place in the n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _pieces(docs: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of pieces of the lower-cased texts: whose it is, its characters with those that its last n-grams need, and how many n-grams start in it at most."""
    group, held = [], 0
    for i, t in enumerate(docs):
        text = f" {t.lower()} "
        for at in range(0, len(text), PIECE):
            group.append((i, text[at : at + PIECE + ORDERS[-1] - 1], min(PIECE, len(text) - at)))
            held += len(group[-1][1])
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _grams(group: list[tuple[int, str, int]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams of a group of pieces side by side, and where each piece's own start and end; what lies between is shared by two pieces and nobody's."""
    points = np.frombuffer("".join(text for _, text, _ in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(text) for _, text, _ in group])
    starts, own = np.cumsum(sizes) - sizes, np.array([n for _, _, n in group])
    places = [points * m for m in MULTIPLIERS]
    for n in ORDERS:
        mixed = np.full(max(0, len(points) - n + 1), n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            mixed = (mixed ^ places[k][k : len(points) - n + 1 + k]) * MULTIPLIERS[0]
            mixed ^= mixed >> np.uint32(15)
        yield (mixed >> np.uint32(32 - bits)).astype(np.int32), starts, starts + np.minimum(own, np.maximum(sizes - n + 1, 0))


def _sums(columns: np.ndarray, buckets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the buckets' columns over each piece."""
    out = np.zeros((len(starts), columns.shape[1]))
    full = np.flatnonzero(ends > starts)
    if len(full):
        values = np.concatenate([columns[buckets], np.zeros((1, columns.shape[1]), dtype=columns.dtype)])
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        # Where one piece ends and the next starts at once, the part between them is a single value that is not taken.
        out[full] = np.add.reduceat(values, edges, axis=0, dtype=np.float64)[::2]
    return out


class Model:
    def __init__(self, languages: list[str], log_probs: np.ndarray, priors: np.ndarray, bits: int):
        self.languages, self.priors, self.bits = languages, priors, bits
        self.columns = np.ascontiguousarray(log_probs.T.astype(np.float32))  # buckets x languages

    def predict(self, docs: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(docs) if t and self.languages and any(map(str.isalpha, t))]
        labels, scores = [UNKNOWN] * len(docs), np.zeros(len(docs))
        if known:
            own = [docs[i] for i in known]
            total = np.tile(self.priors, (len(own), 1))
            for group in _pieces(own):
                for found in _grams(group, self.bits):
                    np.add.at(total, [i for i, _, _ in group], _sums(self.columns, *found))
            total -= total.max(axis=1, keepdims=True)
            odds = np.exp(total)
            scores[known] = 1 / odds.sum(axis=1)
            for i, best in zip(known, total.argmax(axis=1)):
                labels[i] = self.languages[best]
        return labels, scores


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, bits: int = BITS, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on rows that have text and label and are not held out."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = labelled.count()
    if rows > max_train_rows:
        share = max_train_rows / rows
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in text_slices(batches, limit=1 << 19):
            langs = batch.column(1).to_pylist()
            docs = batch.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(docs, langs) if x == lang]
                held.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                rows[lang] = rows.get(lang, 0) + len(own)
                for group in _pieces(own):
                    for buckets, starts, ends in _grams(group, bits):
                        edges = np.zeros(len(buckets) + 1, dtype=np.int32)
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, ends, -1)
                        held[lang] += np.bincount(buckets[np.cumsum(edges[:-1]) > 0], minlength=1 << bits)
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([rows[lang]], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "n", "counts"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << bits, dtype=np.int64)
        for part in parts["counts"]:
            total += np.frombuffer(part, dtype=np.int64)
        return pd.DataFrame({"lang": [key[0]], "n": [int(parts["n"].sum())], "counts": [total.tobytes()]})

    counted = labelled.select("text", "lang").mapInArrow(count, "lang string, n long, counts binary")
    # One row for each language, of a size fixed by ``bits``.
    found = sorted(counted.groupBy("lang").applyInPandas(add, "lang string, n long, counts binary").collect(), key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in found], dtype=np.float64).reshape(len(found), 1 << bits)
    seen = counts.sum(axis=0) > 0
    smooth = counts + 0.5 * np.maximum(seen, 0.01)  # unseen buckets tell the languages apart by nothing
    log_probs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if found else smooth
    log_probs[:, ~seen] = 0
    numbers = np.array([r["n"] for r in found], dtype=np.float64)
    return Model([r["lang"] for r in found], log_probs, np.log(numbers / numbers.sum()) if found else numbers, bits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, limit=1 << 19):
            labels, scores = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose text is in some learned language with at least ``min_score``.

    With the least score of 0 these are all but null texts, texts without a letter and, if no row is labelled, all.
    Where a row of a table with a column ``lang`` has no label, it gets the language predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, limit=1 << 19):
            labels, scores = own.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            at = batch.schema.get_field_index("lang")
            if at >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(batch.column(at), pa.array(labels, batch.schema.field(at).type)))
            yield batch.filter(pa.array([label != UNKNOWN and score >= min_score for label, score in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
