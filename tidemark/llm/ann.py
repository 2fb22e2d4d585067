"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a sample that grows with the leaves, and these with the square root of the rows (``fit_rows`` at
least, ``FIT_BYTES`` at most, in expectation, by a hash of the id); every row is indexed: it goes down to one leaf. A
query walks the tree through a priority queue, always opening the node that promises most: the inner product with its
centre and what the best of its members can be expected to add, by their spread and number. So leaves are ranked. How
many a query visits is calibrated: for a bounded set of queries the true neighbours are found by brute force over all
rows, and visits widen until the share of them found reaches ``recall``; a query whose leaves hold fewer than ``k``
candidates goes on. If a fixed number of visits cannot reach the recall, all leaves are visited.

Queries meet rows by leaf. Leaves that hold many rows, or that many queries visit, are cut into blocks on both sides,
so a vector that a third of all rows share fills no task. Each task keeps the ``k`` best of a query over all its
blocks before the results are shuffled. Scores are inner products of the original vectors in double precision, summed
in the order of the components, so equal vectors score alike and ties fall to the smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id, nor
vectors of another dimension than most. Rows with the query's own id are not its candidates; other repeated rows are
candidates each. A query id that occurs more than once is asked once, with its least vector. Fewer candidates than
``k`` give as many rows; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

FIT_ROWS, FIT_BYTES, CALIBRATION_QUERIES = 20_000, 256 << 20, 300
#: Children of a node, leaves aimed at (more for large tables: their number follows the square root of the rows), rows a leaf is fitted on at least.
BRANCHING, LEAVES, ROOT_SHARE, MIN_LEAF_SAMPLE = 8, 32, 1 / 16, 24
ROW_BLOCK, QUERY_BLOCK = 4096, 2048
#: What the trial queries must reach, so that all queries reach 0.9.
RECALL = 0.94


class Tree:
    """Centres, reach and children of each node; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf_sample: int, seed: int = 7):
        self.centres: list[np.ndarray] = []  # per inner node, the children's
        self.reach: list[np.ndarray] = []  # what the best of a child's members adds to its centre, for a query of length 1
        self.children: list[list[int]] = []  # >= 0 an inner node, < 0 the leaf -1 - number
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(2, leaf_sample))

    def _grow(self, rows: np.ndarray, leaf_sample: int) -> int:
        if len(rows) <= leaf_sample or (rows == rows[0]).all():
            self.leaves += 1
            return -self.leaves
        centres, label = self._cluster(rows)
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.reach.append(np.array([_reach(rows[label == c], centres[c]) for c in range(len(centres))]))
        self.children.append([])
        self.children[node] = [self._grow(rows[label == c], leaf_sample) for c in range(len(centres))]
        return node

    def _cluster(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[self._rng.choice(len(distinct), min(BRANCHING, len(distinct)), replace=False)]
        for _ in range(10):
            label = nearest(rows, centres)
            centres = np.array([rows[label == c].mean(axis=0) for c in range(len(centres)) if (label == c).any()])
        label = nearest(rows, centres)
        used = np.unique(label)
        return centres[used], np.searchsorted(used, label)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                label = nearest(rows[at], self.centres[node])
                todo += [(child, at[label == c]) for c, child in enumerate(self.children[node])]
        return out

    def ranked(self, query: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and more until they hold ``least`` rows by their ``sizes``."""
        queue, found, held = [(0.0, self.root)], [], 0
        length = float(np.sqrt(query @ query))
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += int(sizes[-1 - node]) if sizes is not None else 0
            else:
                for child, promise in zip(self.children[node], (self.centres[node] @ query + length * self.reach[node]).tolist()):
                    heapq.heappush(queue, (-promise, child))
        return found


def _reach(members: np.ndarray, centre: np.ndarray) -> float:
    """The greatest of n normal values of the members' spread in one direction, about."""
    spread = np.sqrt(((members - centre) ** 2).sum(axis=1).mean() / members.shape[1])
    return float(spread * np.sqrt(2 * np.log(max(1, len(members)))))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries, row numbers and exact scores of each query's ``k`` best ``rows`` (fewer if there are fewer).

    A matrix product finds what may be among the best, with some slack for its rounding; only that is summed exactly.
    """
    slack = 1e-9 * (1 + np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(queries), 256):
        rough = queries[low : low + 256] @ rows.T
        rough[own[low : low + 256, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > k:
            least = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k, None] - slack
            q, r = np.nonzero((rough >= least) & (rough > -np.inf))
        else:
            q, r = np.nonzero(rough > -np.inf)
        q += low
        exact = np.zeros(len(q))
        for d in range(rows.shape[1]):
            exact += queries[q, d] * rows[r, d]
        order = np.lexsort((ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        found.append((q[place < k], r[place < k], exact[place < k]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row where ``is_query`` holds, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims["dim"], dims["count"]
    rows = rows.where(F.size("vector") == dim)

    def drawn(of: DataFrame, salt: str, share: float) -> DataFrame:
        return of if share >= 1 else of.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40)) < int(share * (1 << 40)))

    # Both samples are bounded, whatever the table holds.
    leaves = max(LEAVES, ROOT_SHARE * total**0.5)
    fit = min(max(fit_rows, int(2 * MIN_LEAF_SAMPLE * leaves)), max(1, FIT_BYTES // (8 * dim)))
    sample = drawn(rows, "fit", fit / total).select("vector").limit(2 * fit).toArrow()
    fitted = _vectors(sample.column("vector"), dim) if sample.num_rows else np.zeros((1, dim))
    tree = spark.sparkContext.broadcast(Tree(fitted, max(MIN_LEAF_SAMPLE, int(1.5 * len(fitted) / leaves))))

    queries = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("own"))
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trial = drawn(queries, "trial", CALIBRATION_QUERIES / asked).select("id", "vector").limit(2 * CALIBRATION_QUERIES).toArrow()
    visits = _calibrated(rows, tree, trial, dim, k, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.assign(_vectors(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0), batch.column(1)], names=["leaf", "id", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tree.value.ranked(q, visits, held, k + own) for q, own in zip(_vectors(batch.column(1), dim), batch.column(2).to_pylist())]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["leaf", "id", "vector"])

    kind = vectors.schema[vector_col].dataType.simpleString()
    shape = f"leaf long, id long, vector {kind}"
    indexed = checkpoint(rows.select("id", "vector").mapInArrow(index, shape))
    held = np.zeros(tree.value.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf
        held[r["leaf"]] = r["count"]
    visiting = queries.mapInArrow(visit, shape)

    def blocks(of: DataFrame, size: int, name: str) -> DataFrame:
        return of.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias(name))

    # One row per leaf, and the leaves are bounded by the sample the tree was fitted on.
    cut = F.broadcast(blocks(indexed.select("leaf"), ROW_BLOCK, "row_blocks").join(blocks(visiting.select("leaf"), QUERY_BLOCK, "query_blocks"), "leaf"))

    def dealt(of: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).alias(own)
        return of.join(cut, "leaf").select("leaf", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), "id", "vector")

    def compare(key: tuple, asks: pa.Table, has: pa.Table) -> pa.Table:
        if not asks.num_rows or not has.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, ids = asks.column("id").to_numpy(), has.column("id").to_numpy()
        q, r, score = best(_vectors(asks.column("vector"), dim), own, _vectors(has.column("vector"), dim), ids, k)
        return pa.table({"query_id": own[q], "vec_id": ids[r], "score": score})

    by = ["leaf", "row_blocks", "query_blocks"]
    met = dealt(visiting, "query_blocks", "row_blocks").groupBy(*by).cogroup(dealt(indexed, "row_blocks", "query_blocks").groupBy(*by))
    return _top(met.applyInArrow(compare, "query_id long, vec_id long, score double"), k)


def exhaustive(rows: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    """The true neighbours of a stated, bounded set of queries, by blocks over all rows; also each row's vector."""
    shared = rows.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), _vectors(queries.column("vector"), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asks = shared.value
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _vectors(batch.column(1), dim)
            q, r, score = best(asks, own, vectors, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[r]), pa.array(score), batch.column(1).take(pa.array(r))], names=["query_id", "vec_id", "score", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    found = rows.select("id", "vector").mapInArrow(run, f"query_id long, vec_id long, score double, vector {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _calibrated(rows: DataFrame, tree, trial: pa.Table, dim: int, k: int, recall: float) -> int:
    """Leaf visits at which the trial queries find ``recall`` of their true neighbours."""
    if not trial.num_rows:
        return tree.value.leaves
    truth = exhaustive(rows, trial, dim, k).select("query_id", "vector").toArrow()  # k rows for each trial query
    leaf = tree.value.assign(_vectors(truth.column("vector"), dim))
    asks = dict(zip(trial.column("id").to_pylist(), _vectors(trial.column("vector"), dim)))
    rank = {q: {x: i for i, x in enumerate(tree.value.ranked(v, tree.value.leaves))} for q, v in asks.items()}
    needed = np.sort([rank[q][int(x)] + 1 for q, x in zip(truth.column("query_id").to_pylist(), leaf)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else tree.value.leaves
