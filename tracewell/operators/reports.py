"""Ingest reports and metrics as tables (M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def ingest_report(records: DataFrame) -> DataFrame:
    """M1: for each dump what was accepted, dropped and new, and its errors by class."""
    d = records.groupBy("dump_id").agg(
        F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("dropped"),
        F.count_distinct("canonical_key").alias("unique_values"),
    )
    e = records.filter("error is not null").groupBy("dump_id", "error").agg(F.count("*").alias("n"))
    e = e.groupBy("dump_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "error", "n"))), ",").alias("errors"))
    return d.join(e, "dump_id", "left").withColumn("errors", F.coalesce("errors", F.lit("")))


def ingest_counters(records: DataFrame, line_col: str = "line") -> DataFrame:
    """M2: records, errors and bytes."""
    return records.agg(
        F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.octet_length(line_col)), F.lit(0)).cast("long").alias("bytes")
    )


def observed_counters(records: DataFrame, line_col: str = "line", name: str | None = None) -> tuple[DataFrame, Observation]:
    """M2 beside the work that runs anyway: ``records`` that count themselves, and the counts once an action has read them all.

    No second pass: ``observation.get`` holds ``records``, ``errors`` and ``bytes`` after the first action. For a stream
    give the name instead, and read ``query.lastProgress["observedMetrics"][name]``.
    """
    metrics = [
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.octet_length(line_col)), F.lit(0)).cast("long").alias("bytes"),
    ]
    seen = Observation(name) if name else Observation()
    return (records.observe(name, *metrics) if records.isStreaming else records.observe(seen, *metrics)), seen


def histogram(df: DataFrame, col: str, bounds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """M3: ``(by, le, cumulative, sum, count)`` for each bound, as fixed buckets; nulls don't count."""
    d = df.groupBy(*by).agg(
        F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(col) <= b).alias("cumulative")) for b in bounds]).alias("h"),
        F.sum(col).alias("sum"), F.count(col).alias("count"),
    )
    return d.select(*by, F.inline("h"), "sum", "count")


def sync_counters(cycles: DataFrame) -> DataFrame:
    """M4: sync cycles by peer and outcome, with the entries sent and received."""
    return cycles.groupBy("peer", "outcome").agg(F.count("*").alias("n"), F.sum("sent").alias("sent"), F.sum("received").alias("received"))
