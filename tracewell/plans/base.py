"""Inputs that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.canonical import canonicalise_light, with_canonical_key
from tracewell.sources.records import to_cells

SALT = "tracewell"
COLUMNS = {"o_orderstatus": "status", "o_orderpriority": "priority", "o_custkey": "customer"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders as wide dumps: a dump for each month, a row for each order."""
    o = table(spark, d, "orders")
    return to_cells(o, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey"), COLUMNS, F.col("o_orderdate"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with light canonical form and key."""
    c = canonicalise_light(raw_cells(spark, d), "column", "raw")
    return with_canonical_key(c, "column", "canonical", SALT)


def key_sql(kind: str, value: str, salt: str = SALT, version: int = 1) -> str:
    return f"sha256('{salt}:v{version}:' || {kind} || ':' || {value})"


CELLS = f"""
raw_cells AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS dump_id, o_orderkey AS row_index, 0 AS position, 'status' AS col, o_orderstatus AS raw, o_orderdate AS ts FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_orderkey, 1, 'priority', o_orderpriority, o_orderdate FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_orderkey, 2, 'customer', CAST(o_custkey AS VARCHAR), o_orderdate FROM orders),
cells AS (SELECT *, lower(trim(raw)) AS canonical, {key_sql("col", "lower(trim(raw))")} AS k FROM raw_cells WHERE raw IS NOT NULL)
"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as replicated versions of their user: an event type is a node of the network."""
    e = table(spark, d, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    props = F.create_map(
        F.lit("count"), F.lit("1"), F.lit("first_seen"), sec, F.lit("last_seen"), sec, F.lit("context"), F.col("event_type"),
        F.lit("location"), F.col("event_id").cast("string"),
    )
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "user").when(F.col("user_id") % 3 == 1, "sighting").otherwise("device").alias("entity_type"),
        F.col("user_id").cast("string").alias("key"), props.alias("props"), F.col("event_type").alias("origin"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("version"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("tombstone"), F.col("event_id").alias("seq"),
    )


VERSIONS = """
v AS (SELECT CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'sighting' ELSE 'device' END AS entity_type, CAST(user_id AS VARCHAR) AS key,
        event_type AS origin, epoch_us(ts) // 1000 AS timestamp, epoch_us(ts) // 1000000 AS sec, event_id AS version, event_id AS seq,
        event_type = 'error' AND event_id % 5 = 0 AS tombstone FROM events)
"""
