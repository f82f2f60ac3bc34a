"""The registry of queries, and the series that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that says the same."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Revenue and number of orders by region and day."""
    return _daily(spark, d, t(spark, d, "region"), "r_name", "region", ("n_regionkey", "r_regionkey"))


def _daily(spark, d, dim, name, alias, on):
    o, c, n = (t(spark, d, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(dim, n[on[0]] == dim[on[1]])
    return rows.groupBy(F.col(name).alias(alias), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"))


DAILY = """daily AS (SELECT r_name AS region, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and day: number, mean and largest value, users."""
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), F.countDistinct("user_id").alias("users"))


EVENT_DAYS = """event_days AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2)"""
