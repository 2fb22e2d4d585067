"""Connected components of an undirected edge table, by alternating large and small stars.

Every round rewrites the edges so that each node hangs on the smallest node it has seen; the edge count never grows.
Rounds are cut from their lineage through the shared checkpoint folder and end when all that is left are stars around
their smallest node. Nothing but that answer comes to the driver. A hub's edges are met by a join that adaptive execution may split, never by a window or a list.
Edges that are few, from the start or after some rounds, are settled in one task; that saves jobs and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, small_side

MAX_ROUNDS = 60
#: Edges that one task settles at most.
FEW_EDGES = 500_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(u, v)`` with v < u. Large: every greater neighbour of u goes to u's smallest; small: every smaller one."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` is a ``u``: stars around their smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each reaches."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            return names, names[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]


def _at_once(edges: DataFrame) -> DataFrame:
    """``components`` of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            names, roots = _roots(*(np.concatenate(side) for side in zip(*held)))
            below = names != roots
            yield pa.RecordBatch.from_arrays([pa.array(names[below], pa.int64()), pa.array(roots[below], pa.int64())], names=["node", "root"])

    return checkpoint(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge that is not the root itself; ``edges`` holds columns ``u > v``."""
    now = checkpoint(edges.select("u", "v").where("u > v").distinct())
    for _ in range(MAX_ROUNDS):
        if now.count() <= FEW_EDGES:
            return _at_once(now)
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = checkpoint(_stars(_stars(now, large=True), large=False))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def one_of_each(docs: DataFrame, tagged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: one row of each ``root``.

    ``tagged(id, key, root)`` holds a row for every row of ``docs``; ``key`` is ``row_key`` of the text. The least id
    stays (null after all others), of several texts with it the one of the least key, of repeated rows any one. The
    rows that go are told, and sent to the texts where they are few.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    counted = checkpoint(tagged.groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy("root").agg(F.min_by(F.struct("id", "key"), order).alias("best"))
    told = counted.join(best, "root").select(F.col("id").alias("__id"), F.col("key").alias("__key"), "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))).alias("stays"))

    def without(rows: DataFrame, kind: str) -> DataFrame:
        rows = small_side(checkpoint(rows.select("__id", "__key")))
        return docs.join(rows, docs[id_col].eqNullSafe(rows["__id"]) & (row_key(docs[text_col]) == rows["__key"]), kind)

    if counted.where("n > 1").isEmpty():
        return without(told.where("not stays"), "left_anti")
    # Rows that agree in id and text: any one of them.
    often = without(told.where("stays and n > 1"), "left_semi")
    one = often.groupBy(often[id_col], row_key(often[text_col])).agg(F.first(F.struct(*(often[c] for c in docs.columns))).alias("one"))
    return without(told.where("not stays or n > 1"), "left_anti").unionAll(one.select("one.*"))


def row_key(text: Column) -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
