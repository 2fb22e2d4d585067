"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts; an external sort in each range places equals side by side; the
window over a run of equals compares neighbouring rows' whole bytes to tell where a run ends, and the best row of the
run stays. The text travels once.

The leading bytes and a hash stand before the whole bytes in the sort key. They only order unequal texts cheaply and
keep the sampled splitters small; equality is always decided by the whole bytes.

A text that fills more than half of an even share of the ranges (``hot_share`` of all rows, by default half of one
part in the session's shuffle partitions) would hold up a range. Such texts, at most ``1 / hot_share`` of them, are
found by a count of hashes that is combined before its shuffle; their rows carry a further slice number in the sort
key, as many slices as the text has even shares, so that the splitters may fall inside the run. Each slice then yields
one candidate, and the slices of a text are compared in a second small sort. Both the hot texts and their slices number
at most a few times the ranges, whatever the table holds, and so are broadcast.

Null texts count as empty and equal each other. Null ids sort after all others. Of repeated rows with one id and one
text, exactly one is kept. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that normalisation deletes, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
LEAD_BYTES = 48
#: Rows that are never too many for one range.
FEW_ROWS = 64


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    marked = _marked(docs.select(id_col, text_col), id_col, text_col, hot_share)
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    return _marked(docs, id_col, text_col, hot_share).where("kept").select("row.*")


def _marked(docs: DataFrame, id_col: str, text_col: str, hot_share: float | None) -> DataFrame:
    """Whole input rows as ``row``, with their id and what is known of their group."""
    share = hot_share or 0.5 / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    keys = rows.select("row", "id", normalised(text).alias("body")).select("row", "id", F.xxhash64("body").alias("hash"), F.substring("body", 1, LEAD_BYTES).alias("lead"))

    counts = keys.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    many = F.greatest(total * F.lit(share), F.lit(float(FEW_ROWS)))
    hot = counts.select("hash", F.ceil(F.col("n") / many).cast("long").alias("slices")).where("slices > 1")

    # The slice follows from the row's own values (but the text, which all rows of a run share), whoever reads it.
    own = [F.col("row").getField(c) for c in docs.columns if c != text_col]
    keys = keys.join(F.broadcast(hot), "hash", "left")
    keys = keys.withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64(*own), F.col("slices"))).otherwise(F.lit(-1).cast("long"))).drop("slices")
    rows = keys.repartitionByRange("lead", "hash", "slice").select("*", normalised(text).alias("body"), F.char_length(text).alias("points"))

    run = Window.partitionBy("lead", "hash", "slice", "body")
    best = run.orderBy(F.col("points").desc(), F.col("id").asc_nulls_last())
    ranked = rows.select(
        "*",
        F.row_number().over(best).alias("place"),
        F.first("id").over(best).alias("run_keep"),
        F.first("points").over(best).alias("run_points"),
        F.count(F.lit(1)).over(run).alias("run_size"),
    )
    ranked = ranked.withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))

    # Slices of the hot texts: one candidate each, compared once more by whole bytes.
    heads = ranked.where((F.col("slice") >= 0) & (F.col("place") == 1)).select("hash", "slice", "body", "run_keep", "run_points", "run_size")
    same = Window.partitionBy("hash", "body")
    winner = same.orderBy(F.col("run_points").desc(), F.col("run_keep").asc_nulls_last())
    heads = heads.select(
        F.col("hash").alias("of_hash"),
        F.col("slice").alias("of_slice"),
        F.sha2(F.col("body").cast("binary"), 256).alias("of_sha256"),
        F.first("run_keep").over(winner).alias("all_keep"),
        F.sum("run_size").over(same).alias("all_size"),
        (F.row_number().over(winner) == 1).alias("wins"),
    )
    out = ranked.join(
        F.broadcast(heads),
        (F.col("slice") >= 0) & (F.col("hash") == F.col("of_hash")) & (F.col("slice") == F.col("of_slice")) & (F.col("text_sha256") == F.col("of_sha256")),
        "left",
    )
    sliced = F.col("slice") >= 0
    return out.select(
        "row",
        "id",
        F.when(sliced, F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(sliced, F.col("all_size")).otherwise(F.col("run_size")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~sliced | F.coalesce(F.col("wins"), F.lit(False)))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
"""
