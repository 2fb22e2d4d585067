"""The query log: which logged statements are dashboard queries, and their text on one line."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalised(sql: Column) -> Column:
    """Newlines become spaces and runs of spaces one space."""
    return F.regexp_replace(F.regexp_replace(sql.cast("string"), "\n", " "), " +", " ")


def is_dashboard_query(argument: Column, command: Column) -> Column:
    text = argument.cast("string")
    return (command == "Query") & text.like("%meta_data%") & ~text.like("%ignore_cache%") & ~text.like("%general_log%")


def new_queries(log: DataFrame, since: Column, until: Column) -> DataFrame:
    """``event_time, argument, user_host`` of dashboard queries with ``since <= event_time < until``."""
    at = F.col("event_time")
    return log.where((at >= since) & (at < until) & is_dashboard_query(F.col("argument"), F.col("command_type"))).select("event_time", normalised(F.col("argument")).alias("argument"), "user_host")


def read_jdbc_log(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """A database's query log (``event_time, user_host, argument, command_type``), filtered in the database."""
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def archive(queries: DataFrame, path: str) -> None:
    """Keep dashboard queries, by the day they were asked."""
    queries.withColumn("day", F.to_date("event_time")).write.mode("append").partitionBy("day").parquet(path)


def expire_archive(spark: SparkSession, path: str, before: datetime.date) -> list[str]:
    """Remove the days before ``before`` from an archive; returns them."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    days = [f.getPath().getName() for f in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    gone = sorted(d for d in days if d.startswith("day=") and d[4:] < before.isoformat())
    for d in gone:
        fs.delete(at(f"{path}/{d}"), True)
    return gone


def expire(log: DataFrame, before: Column) -> DataFrame:
    """What retention leaves of a log."""
    return log.where(F.col("event_time") >= before)
