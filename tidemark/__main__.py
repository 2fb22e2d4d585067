"""``python -m tidemark CONFIG ROOT LOG_DATABASE``: follow a database's query log with tiers under ROOT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans.engine import Engine
from tidemark.plans.service import Service, jdbc_tables
from tidemark.sources import config as configs
from tidemark.sources import query_log


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("config")
    parser.add_argument("root", help="folder of the tiers")
    parser.add_argument("log_database", help="id of the database whose log is followed")
    parser.add_argument("--log-table", default="general_log")
    parser.add_argument("--driver")
    parser.add_argument("--polls", type=int, help="stop after so many")
    args = parser.parse_args(argv)
    config = configs.load(args.config)
    builder = SparkSession.builder.appName(str(config.settings.get("appName", "tidemark"))).config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR")
    if pools := config.settings.get("schedulerAllocationFile"):
        builder = builder.config("spark.scheduler.allocation.file", str(pools))
    spark = builder.getOrCreate()
    options = config.databases[args.log_database].jdbc_options(args.driver)
    engine = Engine(spark, config, args.root, jdbc_tables(spark, config, args.driver))
    Service(engine, lambda: query_log.read_jdbc_log(spark, options, args.log_table)).run(args.polls)


if __name__ == "__main__":
    main()
