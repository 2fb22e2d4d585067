"""Near copies by word shingles: every pair of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

SimHash alone cannot settle this: at 0.8 fingerprints of 64 bits differ in about ten bits, and a grid that wide meets
nearly all pairs. So SimHash links (4 bits) come first: each text of a linked group is compared with the group's first,
and those similar to it are joined with it. A prefix join then finds what this misses. With shingles in one order that
all texts share, two sets at 0.8 or more have a shingle in common among the first fifth of each, so texts meet in the
cells that these shingles are. The order is rare shingles first, as a sample counts them; the sample changes the work
and never the result.

Long sets meet in parts, dealt by hash: if two sets are similar then so are their shares of one part at least. Both
filters that the join holds thus work on a few hundred shingles, however long a text is: what the shares have left from
the shared shingle on, and their prints, in which a shingle flips one bit. Shares differ in no fewer shingles than their
prints in bits, so pairs with a chance shingle or a passage in common, and most of the copies that are not similar
enough, do not leave the join.

Groups are joined before their pairs are formed: in each cell every text first meets its neighbour by size alone, and
of these meetings each text takes one. In large cells texts then ask the least changed ones, which most others are
similar to. What that joins is one group, and only texts of different groups meet as pairs afterwards. So a group of n
copies costs about n comparisons, not their square, and no link is lost. All candidates are settled on the whole sets
of shingles, each named by 40 bits of its hash.

Texts with equal shingle sets are one node. Fewer words than a shingle are one shingle. Null texts count as empty, and
texts without words are copies of each other. Null and repeated ids are rows like others, further columns are kept, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, small_side, text_slices, texts
from tidemark.llm.components import components, one_of_each, row_key
from tidemark.llm.simhash import SEED, linked, majority, shingle_hashes

#: Similarity as a fraction, so that its tests are in whole numbers.
OVER, UNDER = 4, 5
#: Documents that the order of shingles is learned from, and how many frequent shingles it tells apart.
SAMPLE_DOCS, FREQUENT = 25_000, 200_000
#: Bytes that name a shingle in the sets that are compared, and bits that name it where sets meet.
SET_BYTES, CELL_BITS = 5, 48
#: Shingles of a part are fewer than this, on average; long words that hold a part's print.
PART, PRINT = 256, 4
WORDS = [f"w{k}" for k in range(PRINT)]
#: What a cell tells of a node: its part's size, the place of the cell in its prefix, and the part's print.
STAND = ["n", "at", *WORDS]
#: Parts that large cells are dealt into, each with a node that others ask.
DEALS = 16
#: They ask again while one in so many of their pairs and more than so many are similar, so many times at most; all pairs
#: left come after.
ENOUGH, MANY, ROUNDS = 8, 1000, 6
#: Bytes of text worked on at once.
SLICE = 1 << 19


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the shingles that several documents of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            cells, n = np.unique(np.concatenate([np.unique(shingle_hashes(t, width)) for t in texts(batch)]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n, pa.int64())], names=["cell", "n"])

    every = max(1, docs.count() // SAMPLE_DOCS)
    counts = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counts.where("n > 2").orderBy(F.col("n").desc(), "cell").limit(FREQUENT).toArrow()
    cells, seen = rows["cell"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(cells)
    return cells[order], seen[order]


def _counted(hashes: np.ndarray, cells: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often the sample holds each of ``hashes``, as far as it is told."""
    if not len(cells):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(cells, hashes), len(cells) - 1)
    return np.where(cells[at] == hashes, seen[at], 0)


def _depths(n: int) -> list[int]:
    """How often sets of ``n`` shingles are halved: as deep as their own size and the greatest similar one ask for."""
    return sorted({max(0, (most // PART).bit_length()) for most in (n, n * UNDER // OVER)}) if n else []


def _parts(own: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of ascending distinct hashes: sizes, prints (a row each), cells of the rarest shingles, and how many.

    Parts without shingles stay out. A cell's name tells the depth, so only sets of one depth meet.
    """
    part = (own >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(own), np.int64)
    size = np.bincount(part, minlength=1 << depth)
    first = size - (OVER * size + UNDER - 1) // UNDER + 1
    bit = part * (64 * PRINT) + (own % np.uint64(64 * PRINT)).astype(np.int64)
    prints = np.packbits((np.bincount(bit, minlength=(64 * PRINT) << depth) & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, PRINT)
    order = np.lexsort((counts, part))  # rare first, then by hash
    rare = order[np.arange(len(own)) - (np.cumsum(size) - size)[part] < first[part]]
    cells = (own[rare] >> np.uint64(64 - CELL_BITS)).view(np.int64) | (depth << CELL_BITS)
    held = size > 0
    return size[held], prints[held], cells, first[held]


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def prefixes(docs: DataFrame, width: int) -> DataFrame:
    """``id, key, node, fp, n, parts``: a document's row key, its shingle set by name, SimHash, size and parts.

    Of a part: its size, its print and the cells of its rarest shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def ends(counts: list[int]) -> np.ndarray:
        return np.cumsum([0, *counts]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            rows, parts, held = [], [], []
            for t in texts(batch):
                hashes = shingle_hashes(t, width)
                own = np.unique(hashes)
                rows.append((_node(own), majority(hashes), len(own)))
                counts = _counted(own, *shared.value)
                mine = [_parts(own, counts, depth) for depth in _depths(len(own))]
                held.append(sum(len(p[0]) for p in mine))
                parts += mine
            none = (np.zeros(0, np.int64), np.zeros((0, PRINT), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            size, prints, cells, first = (np.concatenate(x) for x in zip(none, *parts))
            prefix = pa.ListArray.from_arrays(ends(first.tolist()), pa.array(cells, pa.int64()))
            each = pa.StructArray.from_arrays([pa.array(size, pa.int32()), *(pa.array(prints[:, k], pa.int64()) for k in range(PRINT)), prefix], names=["n", *WORDS, "prefix"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.ListArray.from_arrays(ends(held), each)], names=["id", "key", "node", "fp", "n", "parts"])

    part = ", ".join(["n: int", *(f"{w}: long" for w in WORDS), "prefix: array<long>"])
    return docs.select("id", row_key(F.col("text")).alias("key"), "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, node long, fp long, n long, parts array<struct<{part}>>")


def _sets(docs: DataFrame, of: DataFrame, width: int) -> DataFrame:
    """``of`` with ``shingles``, the distinct hashes of the texts that its last columns ``id`` and ``key`` name, as bytes.

    Where they are few the names go to the texts; the sets, not the texts, are what the caller moves.
    """
    at = len(of.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            held = [_packed(np.unique(shingle_hashes(t, width))) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(held, pa.binary())], names=[*batch.schema.names[:at], "shingles"])

    named = small_side(checkpoint(of.withColumnsRenamed({"id": "__id", "key": "__key"})))
    met = docs.join(named, docs["id"].eqNullSafe(named["__id"]) & (row_key(docs["text"]) == named["__key"]))
    kept = [c for c in of.columns if c not in ("id", "key")]
    kinds = ", ".join(f"{c} {of.schema[c].dataType.simpleString()}" for c in kept)
    return met.select(*kept, "text").mapInArrow(run, f"{kinds}, shingles binary")


def _packed(hashes: np.ndarray) -> bytes:
    names = np.unique(hashes >> np.uint64(64 - 8 * SET_BYTES))
    return names.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def _unpacked(shingles: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(shingles.as_buffer(), np.uint8).reshape(-1, SET_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :SET_BYTES] = raw
    return out.view(np.uint64).ravel()


def _similar(pairs: DataFrame) -> DataFrame:
    """``u, v`` of those ``pairs(u, v, a, b)`` whose shingle sets ``a`` and ``b`` are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = _unpacked(a), _unpacked(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                stay.append((OVER + UNDER) * both >= OVER * (len(x) + len(y)))
            yield batch.select(["u", "v"]).filter(pa.array(stay, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _near_first(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``u, v``: nodes that SimHash links (4 bits) put into one group, with the group's first node where similar to it."""
    grouped = nodes.join(linked(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), 4).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = grouped.groupBy("root").agg(F.min_by(F.struct("node", "n"), "node").alias("head"), F.count(F.lit(1)).alias("held")).where("held > 1")
    fits = (OVER * F.greatest("n", "head.n") <= UNDER * F.least("n", "head.n"))
    star = grouped.join(heads, "root").where(fits).select(F.col("node").alias("u"), F.col("head.node").alias("v"), "id", "key")
    sets = _sets(docs, star, width)
    first = sets.where("u = v").select(F.col("v").alias("head"), F.col("shingles").alias("b"))
    return checkpoint(_similar(sets.where("u != v").withColumnRenamed("shingles", "a").join(first, F.col("v") == F.col("head"))))


def _reach(a: str, b: str) -> Column:
    """Two parts that share a shingle: neither has more left than it holds from there on.

    ``a`` and ``b`` name the columns ``STAND`` of both, with braces where the names go.
    """
    n_a, at_a, n_b, at_b = (F.col(side.format(c)) for side in (a, b) for c in ("n", "at"))
    return (OVER + UNDER) * F.least(n_a - at_a, n_b - at_b) >= OVER * (n_a + n_b)


def _alike(a: str, b: str) -> Column:
    """The prints of two parts differ in no more bits than similar parts in shingles."""
    differ = reduce(add, (F.bit_count(F.col(a.format(w)).bitwiseXOR(F.col(b.format(w)))) for w in WORDS))
    return (OVER + UNDER) * differ <= (UNDER - OVER) * (F.col(a.format("n")) + F.col(b.format("n")))


def _part_of(cell: str) -> Column:
    """The name of the part, one of its node's, that a cell is of: its depth and the first bits of its hashes."""
    depth = F.shiftright(cell, CELL_BITS).cast("int")
    return F.call_function("shiftright", F.col(cell), F.lit(CELL_BITS) - depth).alias("part")


def _printed(nodes: DataFrame) -> DataFrame:
    """``node, part, n`` and the print of all parts."""
    parts = nodes.select("node", F.explode("parts").alias("of")).withColumn("cell", F.col("of.prefix")[0])
    return parts.select("node", _part_of("cell"), "of.n", *(f"of.{w}" for w in WORDS))


def _shared(nodes: DataFrame) -> DataFrame:
    """``cell, part, node`` and ``STAND`` of the shingles that the prefixes of several nodes hold.

    ``before`` is the neighbour by size, where it has enough left. Most cells have one node, so only those that are
    left get the prints.
    """
    cells = nodes.select("node", F.explode("parts").alias("of")).select("node", "of.n", F.posexplode("of.prefix").alias("at", "cell"))
    by_size = Window.partitionBy("cell").orderBy("n", "node")
    met = cells.select("*", F.lag(F.struct("node", "n", "at")).over(by_size).alias("before"), F.lead("node").over(by_size).alias("after")).where("before is not null or after is not null")
    held = met.select("cell", _part_of("cell"), "node", "at", F.when(_reach("{}", "before.{}"), F.col("before.node")).alias("before"))
    return held.hint("merge").join(_printed(nodes), ["node", "part"]).select("cell", "part", "node", *STAND, "before")


def _beside(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v`` (u > v): nodes and their neighbours with parts that may be similar."""
    asked = shared.where("before is not null").select("node", "before", "part", "n", *WORDS).distinct()
    other = _printed(nodes).select(F.col("node").alias("before"), "part", *(F.col(c).alias(f"{c}_before") for c in ("n", *WORDS)))
    alike = asked.hint("merge").join(other, ["before", "part"]).where(_alike("{}", "{}_before"))
    return alike.select(F.greatest("node", "before").alias("u"), F.least("node", "before").alias("v")).distinct()


def _with_plainest(cells: DataFrame, seed: int) -> DataFrame:
    """``u, v`` (u > v): in each large cell, every node with some that are most likely to be similar to it.

    A set with few rare shingles before a shared one has been changed least, and is similar to most others. Cells are
    dealt into ``DEALS`` parts by node; the plainest node of each is asked by the nodes whose turn it is there, which
    is another part in every cell and for every ``seed``. Small cells have parts of one node and stay out: their pairs
    are few.
    """
    mine = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(DEALS)).alias("deal")
    plainest = cells.groupBy("cell", mine).agg(F.min(F.struct("at", "node", "root", *(c for c in STAND if c != "at"))).alias("asked"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    turn = F.pmod(F.xxhash64("node", "cell", F.lit(seed)), F.lit(DEALS)).alias("deal")
    met = cells.select("cell", turn, "node", "root", *STAND).hint("merge").join(plainest, ["cell", "deal"]).where("root != asked.root")
    return met.where(_reach("{}", "asked.{}") & _alike("{}", "asked.{}")).select(F.greatest("node", "asked.node").alias("u"), F.least("node", "asked.node").alias("v")).distinct()


def _meeting(cells: DataFrame) -> DataFrame:
    """``u, v`` (u > v): nodes of different groups with parts that may be similar.

    The optimiser does not see how many cells a text stands in, so no side is ever broadcast.
    """
    a, b = (cells.select(*(F.col(c).alias(c + side) for c in ("cell", "node", "root", *STAND))) for side in ("_a", "_b"))
    met = a.hint("merge").join(b, (F.col("cell_a") == F.col("cell_b")) & (F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _reach("{}_a", "{}_b") & _alike("{}_a", "{}_b"))
    return met.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose nodes are not in one group yet."""
    of = lambda node: F.coalesce(F.col(f"root_{node}"), F.col(node))
    rooted = pairs.join(roots.toDF("u", "root_u"), "u", "left").join(roots.toDF("v", "root_v"), "v", "left")
    return rooted.where(of("u") != of("v")).select("u", "v")


def _placed(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """``cells`` with the ``root`` of the group that each node is in."""
    return cells.join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` with the links ``found`` (u > v) since."""
    return components(roots.toDF("u", "v").unionAll(found))


def _compared(docs: DataFrame, named: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` (u > v) that are similar. One side's set goes with every pair, the other's once."""
    left = _sets(docs, pairs.join(named, pairs["u"] == named["name"]).select("u", "v", "id", "key"), width).withColumnRenamed("shingles", "a")
    right = _sets(docs, named.join(pairs.select(F.col("v").alias("name")).distinct(), "name").select("name", "id", "key"), width).withColumnRenamed("shingles", "b")
    return checkpoint(_similar(left.join(right, F.col("v") == F.col("name"))))


def _rooted(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``prefixes`` of ``docs(id, text)``, and ``node, root`` of each different set of shingles."""
    # Rows of a checkpoint keep their places, so their numbers name them.
    prints = checkpoint(prefixes(docs, width)).withColumn("row", F.monotonically_increasing_id())
    rows = prints.select("node", "row")
    copies = checkpoint(rows.join(rows.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1"), "node").where("row != first").select("row"))
    nodes = prints.join(small_side(copies), "row", "left_anti")
    near = _near_first(docs, nodes.select("node", "fp", "n", "id", "key"), width)
    links = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    named = nodes.select(F.col("node").alias("name"), "id", "key")
    shared = checkpoint(_shared(nodes))

    def one_each(pairs: DataFrame) -> DataFrame:
        return checkpoint(pairs.groupBy("u").agg(F.min("v").alias("v")))

    # Neighbours first.
    beside = _beside(shared, nodes)
    roots = components(links)
    asked = one_each(_apart(beside, roots))
    roots = _joined(roots, _compared(docs, named, asked, width))
    # Then the plainest nodes of large cells, as long as that joins much.
    cells = shared.drop("before", "part")
    for seed in range(ROUNDS):
        pairs = checkpoint(_with_plainest(_placed(cells, roots), seed).join(asked, ["u", "v"], "left_anti"))
        found = _compared(docs, named, pairs, width)
        roots, asked = _joined(roots, found), asked.unionAll(pairs)
        joined = found.count()
        if joined <= MANY or joined * ENOUGH < pairs.count():
            break
    # At last all that meet and are still apart.
    rest = checkpoint(_meeting(_placed(cells, roots)).join(asked, ["u", "v"], "left_anti"))
    roots = _joined(roots, _compared(docs, named, rest, width))
    return prints, nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id`` of every row: the smallest id among the documents that similar pairs connect."""
    prints, rooted = _rooted(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), width)
    named = prints.groupBy("node").agg(F.min("id").alias("least_id")).join(rooted, "node")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.select("id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("id", "component_id")


def representatives(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group: see ``one_of_each``."""
    prints, rooted = _rooted(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), width)
    return one_of_each(docs, prints.join(rooted, "node").select("id", "key", "root"), id_col, text_col)
