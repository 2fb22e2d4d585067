"""What the corpus operators share: reading tables, shared scratch space, and cutting Arrow batches to size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows that are sent to every executor at most.
FEW_ROWS = 500_000


def small_side(rows: DataFrame) -> DataFrame:
    """``rows``, a checkpoint of narrow rows, for a join: broadcast where they are counted and few."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (one row at least), to bound working memory."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, size in enumerate(_sizes(values)):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def _sizes(values: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return [v or b"" for v in values.to_pylist()]
