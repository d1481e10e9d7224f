"""Queries that run a stream to its end and return what it wrote; their SQL is the batch twin's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.plans.base import ORACLE, query, table, versions
from tracewell.plans.graphs import _flat, _jobs, _values
from tracewell.plans.replication import _MARK, _RULES, _log, _plain
from tracewell.scratch import shared_dir
from tracewell.sources.changelog import pull_stream as pull
from tracewell.streaming import streams as T


def _stream(spark, df, name: str):
    """``df`` written as files, more of them the more rows it has, read as a stream of at least three batches."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files = max(6, df.count() // 200_000)
    df.repartition(files).write.parquet(f"{base}/in")
    return T.read_jobs(spark, f"{base}/in", df.schema, -(-files // 3)), base


@query("stream_upsert", ORACLE["upsert_props"])
def upsert(spark, d):
    # rows are dealt to files at random, so most batches hold older jobs than the table
    s, base = _stream(spark, _jobs(spark, d), "upsert")
    T.stream_upsert(s, f"{base}/t", f"{base}/c").awaitTermination()
    return _flat(T.latest(spark, f"{base}/t", T.NODES))


@query("stream_rejects", "SELECT event_type = 'error' AS rejected, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id ELSE user_id END) AS n FROM events GROUP BY 1")
def rejects(spark, d):
    jobs = _jobs(spark, d).withColumn("key", F.when(F.exists(F.map_values("props"), lambda v: v.isNotNull()), F.col("key")))
    s, base = _stream(spark, jobs, "rejects")
    T.stream_with_rejects(s, f"{base}/t", f"{base}/r", f"{base}/c").awaitTermination()
    good = T.latest(spark, f"{base}/t", T.NODES).select(F.lit(False).alias("rejected"))
    bad = spark.read.parquet(f"{base}/r").select(F.lit(True).alias("rejected"))
    return good.unionByName(bad).groupBy("rejected").agg(F.count("*").alias("n"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark, d):
    s, base = _stream(spark, table(spark, d, "events").select("user_id", "event_type"), "dedup")
    T.stream_new_only(s, f"{base}/t", f"{base}/c", ["user_id", "event_type"]).awaitTermination()
    return spark.read.parquet(f"{base}/t").select("user_id", "event_type")


@query("stream_dedup_within", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_within(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s, base = _stream(spark, e, "dedup-within")
    T.stream_new_only(s, f"{base}/t", f"{base}/c", ["user_id", "event_type"], within="90 days").awaitTermination()
    return spark.read.parquet(f"{base}/t").select("user_id", "event_type")


@query("stream_pairs", "SELECT 'event_type:' || event_type AS a_key, 'user_id:' || user_id AS b_key, count(*) AS n FROM events GROUP BY 1, 2")
def pairs(spark, d):
    s, base = _stream(spark, table(spark, d, "events").select("user_id", "event_type"), "pairs")
    T.stream_pair_counts(s, ["user_id", "event_type"], f"{base}/t", f"{base}/c").awaitTermination()
    return T.latest(spark, f"{base}/t", T.PAIRS).select("a_key", "b_key", F.col("count").alias("n"))


@query("stream_merge", ORACLE["merge_rules"])
def merge(spark, d):
    # files are dealt at random, so batches are out of order
    v = versions(spark, d)
    s, base = _stream(spark, v, "merge")
    T.stream_merge(s, _RULES, f"{base}/c").awaitTermination()
    return _plain(T.merged_state(spark, f"{base}/c"))


@query("pull_stream", ORACLE["pull_since"])
def pull_stream(spark, d):
    base = f"{shared_dir(spark)}/pull-{uuid.uuid4().hex}"
    _log(spark, d).repartition(6).write.parquet(f"{base}/log")
    s = pull(spark, f"{base}/log", (_MARK, "999999999")).select("timestamp", "id")
    s.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_enrich", ORACLE["blocklist"])
def enrich(spark, d):
    v = _values(spark, d)
    bad = v.filter(F.split_part("canonical", F.lit("."), F.lit(1)).cast("int") < 100).select("canonical")
    s, base = _stream(spark, v, "enrich")
    T.stream_enrich(s, bad, "blocklist", f"{base}/t", f"{base}/c").awaitTermination()
    return spark.read.parquet(f"{base}/t").select("canonical", "listed")
