"""Near duplicates by SimHash: fingerprints of word shingles, linked through a segment-popcount grid.

Fingerprints need one pass over the text. Everything after it works on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, text_slices, texts
from tidemark.llm.components import components, one_of_each, row_key

SEED = 42
#: Every other bit of a 64-bit word.
EVEN_BITS = 0x5555555555555555
#: Fixed value: A-Z to a-z, every other byte to itself.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of ``text``'s word shingles in order of occurrence; none for a text without words."""
    words = text.translate(LOWER).split()  # splits on ASCII white space only
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of ``text``'s word shingles as a signed number; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, fp``: the fingerprint of every whole text, and its row key; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t, width) for t in texts(batch)], pa.int64())], names=["id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), row_key(docs[text_col]).alias("key"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, key long, fp long")


def _counts(fp: Column) -> Column:
    """The segment-popcount embedding: bit counts (0 to 2) of the 32 two-bit segments, each in its own two bits."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _slabs(distance: int, radius: int) -> list[list[int]]:
    """The 32 segments in as few equal slabs as force one of them to a Manhattan distance of at most ``radius``."""
    n = distance // (radius + 1) + 1
    return [list(range(32 * k // n, 32 * (k + 1) // n)) for k in range(n)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _at(slab: int, cell: Column, move: int) -> Column:
    return F.struct(F.lit(slab).alias("slab"), cell.alias("cell"), F.lit(move).alias("move"))


def _moved(cell: Column, segment: int, up: bool) -> Column:
    """The cell with one bit more (or less) counted in ``segment``; null where no more (or none) are."""
    at = 2 * segment
    count = F.shiftrightunsigned(cell, at).bitwiseAND(F.lit(3))
    one, three = F.lit(_signed(1 << at)), F.lit(_signed(3 << at))
    between = ((0, one), (1, three)) if up else ((1, one), (2, three))  # 00 and 01 differ by 01, 01 and 10 by 11
    return F.when(count == between[0][0], cell.bitwiseXOR(between[0][1])).when(count == between[1][0], cell.bitwiseXOR(between[1][1]))


def _stands(own: DataFrame, slabs: list[list[int]], moves: tuple[bool, ...]) -> DataFrame:
    """``slab, cell, move`` and what ``own`` has: each fingerprint in the cell of every slab (move 0), and in those one of ``moves`` away."""
    cells = []
    for k, segments in enumerate(slabs):
        cell = F.col("counts").bitwiseAND(F.lit(_signed(sum(3 << (2 * s) for s in segments))))
        cells += [_at(k, c, move) for move, c in enumerate((cell, *(_moved(cell, s, up) for up in moves for s in segments)))]
    kept = [c for c in own.columns if c != "counts"]
    return own.select(*kept, F.explode(F.array(*cells)).alias("c")).where(F.col("c.cell").isNotNull()).select(*kept, "c.slab", "c.cell", "c.move")


def _counted(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("counts", _counts(F.col("fp")))


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(distinct: DataFrame, distance: int, radius: int = 2) -> DataFrame:
    """``u, v`` (u > v): pairs of the distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Where ``distinct`` has a column ``root`` too, only the pairs of different roots.

    Bits that differ change the segment counts by no more than their number, so the counts' Manhattan distance is a
    lower bound. Of the slabs the segments are dealt into, one at least is within ``radius`` (0 to 2); a slab's counts
    are a grid cell. For radius 0 fingerprints meet in their own cell. For radius 1 one side also stands in the cells
    one step up, since of a pair one step apart one is below. For radius 2 both sides stand in the cells one step up
    or down: of a pair two steps apart, some cell is one step from each. Wider slabs hold more bits, so they give
    fewer candidates for more cells. Candidates meet by an equi-join on the cell, and the exact bit difference is
    tested inside the join. Of the cells that a pair shares in a slab only these count: the own one of both, the own
    one of the greater, or those between the two.

    The join is always a merge join: the optimiser takes a side for as small as the fingerprints it was made from, and
    would send all their cells to the driver and every executor.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    slabs = _slabs(distance, radius)
    own = _counted(distinct)
    left = _stands(own, slabs, ((), (True,), (True, False))[radius])
    right = left if radius == 2 else _stands(own, slabs, ())
    a, b = (side.select(*(F.col(c).alias(f"{c}_{at}") for c in side.columns)) for side, at in ((left, "u"), (right, "v")))
    greater, moved_u, moved_v = F.col("fp_u") > F.col("fp_v"), F.col("move_u") > 0, F.col("move_v") > 0
    once = {
        0: greater,
        1: (F.col("fp_u") != F.col("fp_v")) & (moved_u | greater),
        2: greater & (~moved_u | (moved_v & (F.col("move_u") != F.col("move_v")))),
    }[radius]
    apart = [F.col("root_u") != F.col("root_v")] if "root" in distinct.columns else []
    met = a.hint("merge").join(b, reduce(and_, [F.col("slab_u") == F.col("slab_v"), F.col("cell_u") == F.col("cell_v"), *apart, once, _near("fp_u", "fp_v", distance)]))
    return met.select(F.greatest("fp_u", "fp_v").alias("u"), F.least("fp_u", "fp_v").alias("v")).distinct()


def _placed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes(fp)`` with the ``root`` of the group that each is in."""
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _pair(other: str) -> list[Column]:
    return [F.greatest("fp", other).alias("u"), F.least("fp", other).alias("v")]


def linked(nodes: DataFrame, distance: int) -> DataFrame:
    """``node, root`` (as ``components`` has them) of the distinct fingerprints ``nodes(fp, n)`` that links connect.

    Large groups are joined before their pairs are formed. In each cell of a slab all first ask the fingerprint of
    most rows ``n``; then all in the cells around ask the one of most rows in each group so made. At last only pairs
    of different groups meet, so a group of near copies costs about its size and not its square, and no link is lost.
    """
    slabs, nodes = _slabs(distance, 2), checkpoint(nodes.select("fp", "n"))
    own = _stands(_counted(nodes), slabs, ()).drop("move")
    hubs = own.groupBy("slab", "cell").agg(F.max_by("fp", "n").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    roots = components(own.drop("n").hint("merge").join(hubs, ["slab", "cell"]).where((F.col("fp") != F.col("hub")) & _near("fp", "hub", distance)).select(*_pair("hub")))
    heads = _placed(nodes, roots).groupBy("root").agg(F.max_by("fp", "n").alias("fp"), F.count(F.lit(1)).alias("held")).where("held > 1").select("fp", "root")
    around = _stands(_counted(heads), slabs, (True, False)).select(F.col("fp").alias("head"), F.col("root").alias("asked"), "slab", "cell")
    standing = _stands(_counted(_placed(nodes, roots).select("fp", "root")), slabs, ()).drop("move")
    found = standing.hint("merge").join(around, ["slab", "cell"]).where((F.col("root") != F.col("asked")) & _near("fp", "head", distance)).select(*_pair("head"))
    roots = components(roots.toDF("u", "v").unionAll(found))
    return components(roots.toDF("u", "v").unionAll(links(_placed(nodes, roots).select("fp", "root"), distance)))


def _rooted(prints: DataFrame, distance: int) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint."""
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    rooted = _placed(nodes.drop("n"), linked(nodes, distance))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: whole texts whose fingerprints link at ``distance`` bits or fewer.

    Equal fingerprints are one node, so copies cost nothing beyond their fingerprint. Null and empty texts have
    fingerprint zero and link like any other. Null ids keep their rows; the component is then named by its smallest
    id that is not null. Repeated rows and ties are rows of one component. Further columns are ignored; an empty
    table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, width, id_col, text_col))
    # A fingerprint that many rows share is on one side only, which adaptive execution splits.
    return prints.join(_rooted(prints, distance), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: see ``one_of_each``."""
    prints = checkpoint(fingerprints(docs, width, id_col, text_col))
    return one_of_each(docs, prints.join(_rooted(prints, distance), "fp").select("id", "key", "root"), id_col, text_col)
