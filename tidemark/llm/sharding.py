"""Sharding by extendible hashing, in DataFrame operations only.

A row's place is a 60-bit hash of its id. The directory is indexed by the leading bits of that hash: a bucket of some
depth holds the rows that share so many bits, and only a bucket whose bytes exceed the limit is split on another bit.
Bytes are summed once per fine prefix (a few times as many as there will be shards), and the sums of all coarser
prefixes follow from these, so the depth of each bucket is known without touching the rows again; buckets that are too
large even at the finest prefix take a further round over their own rows with more bits.

What no bit can part, rows with one hash, becomes overflow pages: such rows are numbered within the task that reads
them and a new page starts where the limit would be passed. A single row over the limit has a page of its own.

Null texts have no bytes, null ids hash as the empty text. Repeated rows are rows of one hash. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

HASH_BITS, ROUND_BITS = 60, 10
BROADCAST_BITS = 14


def place(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _depths(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``prefix`` of ``high`` bits -> ``depth`` at which its bucket fits, from ``low`` on; ``high + 1`` if none does."""
    every = sums.select("prefix", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = F.expr(f"shiftright(prefix, {high} - depth)")
    totals = every.groupBy("depth", at.alias("bucket")).agg(F.sum("bytes").alias("held"))
    full = totals.where(F.col("held") > limit)
    lookup = every.select("prefix", "depth", at.alias("bucket")).join(full, ["depth", "bucket"], "left")
    return lookup.groupBy("prefix").agg(F.coalesce(F.max(F.when(F.col("held").isNotNull(), F.col("depth"))) + 1, F.lit(low)).alias("depth"))


def _with_depth(rows: DataFrame, depths: DataFrame, bits: int) -> DataFrame:
    """A table of at most 2 ** ``bits`` rows is broadcast while that bound is small."""
    return rows.join(F.broadcast(depths) if bits <= BROADCAST_BITS else depths, "prefix")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", round_bits: int = ROUND_BITS) -> DataFrame:
    """``doc_id, n_bytes, depth, shard``: every row with its shard, the shard's bits as text (``-`` for the whole)."""
    out = _assigned(docs.select(docs[id_col].alias("id"), place(docs[id_col]).alias("hash"), _size(docs[text_col])), limit, round_bits)
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard")


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("bytes")


def _assigned(rows: DataFrame, limit: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """``rows``, whose columns ``hash`` and ``bytes`` tell where they go, with ``depth`` and ``shard``."""
    columns = rows.columns
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, 3 + max(0, math.ceil(math.log2(max(1, total / limit)))))
    done, rest = [], rows
    while True:
        prefixed = rest.withColumn("prefix", F.shiftright("hash", HASH_BITS - high))
        depths = _depths(prefixed.groupBy("prefix").agg(F.sum("bytes").alias("bytes")), low, high, limit)
        found = _with_depth(prefixed, depths, high - low if not low else HASH_BITS)
        done.append(found.where(F.col("depth") <= high).select(*columns, "depth", F.lit("").alias("page")))
        if depths.where(F.col("depth") > high).isEmpty():
            break
        rest = checkpoint(found.where(F.col("depth") > high).select(*columns))  # else the plan doubles each round
        if high == HASH_BITS:
            done.append(_pages(rest, limit))
            break
        low, high = high + 1, min(HASH_BITS, high + round_bits)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    bits = F.lpad(F.bin(F.expr(f"shiftright(hash, {HASH_BITS} - depth)")), F.col("depth"), F.lit("0"))
    name = F.when(F.col("depth") == 0, F.lit("-")).otherwise(bits)
    return out.select(*columns, "depth", F.concat(name, "page").alias("shard"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows no hash bit parts, dealt into pages per reading task: half a limit's running total a page, so that with the row that crosses it a page still fits; larger rows alone."""
    task = rows.withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    large = F.col("bytes") > limit // 2
    upto = F.sum(F.when(large, F.lit(0).cast("long")).otherwise(F.col("bytes"))).over(Window.partitionBy("hash", "task").orderBy("row"))
    page = F.when(large, F.concat(F.lit("+"), "row")).otherwise(F.concat(F.lit("+"), "task", F.lit("."), F.floor(upto / F.lit(max(1, limit // 2)))))
    return task.select(*rows.columns, F.lit(HASH_BITS).alias("depth"), page.alias("page"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``docs`` with one folder per shard; rows of one id or none are rows like others."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"))
    of = whole["whole"]
    rows = whole.select("whole", place(of.getField(id_col)).alias("hash"), _size(of.getField(text_col)))
    _assigned(rows, limit).select("whole.*", F.col("shard").alias("__shard")).repartition("__shard").write.partitionBy("__shard").parquet(path)


def oracle(limit: int) -> str:
    """In SQL, as far as bits can part rows: pages of one hash follow the reading tasks, so their names stay open here."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), e AS (SELECT d.*, t.k AS depth, h >> (60 - t.k::INT) AS prefix FROM d, range(0, 61) AS t(k)),
s AS (SELECT depth, prefix FROM e GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
m AS (SELECT doc_id, n_bytes, h, min(s.depth)::INT AS least FROM e LEFT JOIN s USING (depth, prefix) GROUP BY ALL)
SELECT doc_id, n_bytes, coalesce(least, 60) AS depth,
       CASE WHEN least = 0 THEN '-' WHEN least IS NULL THEN lpad(bin(h), 60, '0') || '+' ELSE lpad(bin(h), 60, '0')[1:least] END AS shard
FROM m
"""
