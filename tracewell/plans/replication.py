"""Queries for replication and reconciliation, over events as versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import reconcile as R, reports as M
from tracewell.plans.base import VERSIONS, query, stamp, table, versions
from tracewell.scratch import cut

_LWW = f"""{VERSIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY entity_type, key ORDER BY tombstone DESC, timestamp DESC, origin DESC, version DESC, seq) AS r FROM v)"""
_ONE = "'1' AS n, CAST(sec AS VARCHAR) AS first_seen, CAST(sec AS VARCHAR) AS last_seen, origin AS context, CAST(version AS VARCHAR) AS location"
_OUT = f"entity_type, key, origin, timestamp, tombstone, {_ONE}"


def _plain(df):
    p = F.col("props")
    return df.select(
        "entity_type", "key", "origin", "timestamp", "tombstone", p["count"].alias("n"), p["first_seen"].alias("first_seen"),
        p["last_seen"].alias("last_seen"), p["context"].alias("context"), p["location"].alias("location"),
    )


_SIGHT = f"""{VERSIONS}, g AS (SELECT entity_type, key, count(*) AS n, min(sec) AS first_seen, max(sec) AS last_seen, arg_max(origin, (timestamp, origin)) AS context, arg_min(version, seq) AS location,
  max(timestamp) AS timestamp FROM v GROUP BY 1, 2)"""
_SIGHT_OUT = "entity_type, key, CAST(n AS VARCHAR) AS n, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, context, CAST(location AS VARCHAR) AS location, timestamp"


def _sighted(df):
    p = F.col("props")
    return df.select("entity_type", "key", p["count"].alias("n"), p["first_seen"].alias("first_seen"), p["last_seen"].alias("last_seen"), p["context"].alias("context"), p["location"].alias("location"), "timestamp")


@query("merge_lww", f"WITH {_LWW} SELECT {_OUT} FROM w WHERE r = 1")
def lww(spark, d):
    return _plain(R.merge_lww(versions(spark, d)))


@query("merge_tombstone", f"WITH {_LWW.replace(chr(39) + 'error' + chr(39) + ' AND event_id % 5 = 0', chr(39) + 'view' + chr(39) + ' AND event_id % 2 = 0')} SELECT {_OUT} FROM w WHERE r = 1")
def tombstone(spark, d):
    # half of the views delete, so most keys have several tombstones among later versions
    v = versions(spark, d).withColumn("tombstone", (F.col("origin") == "view") & (F.col("version") % 2 == 0))
    return _plain(R.merge_tombstone(v))


@query("merge_sightings", f"WITH {_SIGHT} SELECT {_SIGHT_OUT} FROM g")
def sightings(spark, d):
    return _sighted(R.merge_sightings(versions(spark, d)))


_RULES = {"sighting": "sighting", "device": "tombstone"}
_MERGED = f"""{_LWW}, dead AS (SELECT DISTINCT key FROM v WHERE tombstone),
g AS (SELECT entity_type, key, count(*) AS n, min(sec) AS first_seen, max(sec) AS last_seen, arg_max(origin, (timestamp, origin)) AS context, arg_min(version, seq) AS location,
  arg_max(origin, (timestamp, origin, version)) AS origin, max(timestamp) AS timestamp FROM v WHERE entity_type = 'sighting' AND key NOT IN (SELECT key FROM dead) GROUP BY 1, 2),
m AS (SELECT {_OUT} FROM w WHERE r = 1 AND (entity_type <> 'sighting' OR key IN (SELECT key FROM dead))
UNION ALL SELECT entity_type, key, origin, timestamp, false, CAST(n AS VARCHAR), CAST(first_seen AS VARCHAR), CAST(last_seen AS VARCHAR), context, CAST(location AS VARCHAR) FROM g)"""


@query("merge_rules", f"WITH {_MERGED} SELECT * FROM m")
def rules(spark, d):
    return _plain(R.merge(versions(spark, d), _RULES))


@query("merge_kway", f"WITH {_MERGED} SELECT * FROM m")
def kway(spark, d):
    v = versions(spark, d)
    out = None
    for i in range(4):  # four replicas, each merged by itself before, in any order
        part = R.merge(v.filter(F.col("seq") % 4 == 3 - i), _RULES)
        out = part if out is None else out.unionByName(part)
    return _plain(R.merge(out, _RULES))


@query("reconcile", f"WITH {_MERGED} SELECT *, 4 AS times FROM m")
def reconcile(spark, d):
    """Two replicas apply each other's states, and what comes out is applied to both again: four times the same rows."""
    v = versions(spark, d)
    early = F.col("timestamp") < F.lit(1_705_500_000_000)
    home = F.col("origin").isin("view", "click")
    a, b = (cut(R.replica_state(v.filter(mine | early), _RULES), name) for mine, name in ((home, "replica-a"), (~home, "replica-b")))
    ab, ba = (cut(R.reconcile(*x, _RULES), "reconciled") for x in ((a, b), (b, a)))
    every = [_plain(x) for x in (ab, ba, R.reconcile(ab, a, _RULES), R.reconcile(b, ba, _RULES))]
    all_ = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    return all_.groupBy(*every[0].columns).agg(F.count("*").cast("int").alias("times"))


@query("merge_quarantine", "SELECT event_type = 'error' AS rejected, count(*) AS n FROM events GROUP BY 1")
def quarantine(spark, d):
    ok, bad = R.split_mergeable(versions(spark, d).withColumn("key", F.when(F.col("origin") != "error", F.col("key"))))
    return ok.select(F.lit(False).alias("rejected")).unionByName(bad.select(F.lit(True).alias("rejected"))).groupBy("rejected").agg(F.count("*").alias("n"))


def _states(spark, d):
    """Customers before and after: some changed, some gone, some new."""
    c = table(spark, d, "customer").select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_mktsegment")
    old = c.filter("c_custkey % 7 <> 0").select("label", "key", F.create_map(F.lit("s"), F.col("c_mktsegment")).alias("props"))
    seg = F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    new = c.filter("c_custkey % 11 <> 0").select("label", "key", F.create_map(F.lit("s"), seg).alias("props"))
    return old, new


@query("changelog", """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 7 <> 0 AS o, c_custkey % 11 <> 0 AS n, c_custkey % 5 = 0 AS ch, c_mktsegment AS seg FROM customer)
SELECT 'Customer' AS label, key, CASE WHEN n THEN CASE WHEN ch THEN 'CHANGED' ELSE seg END END AS s, 'b' AS origin, NOT n AS tombstone, CASE WHEN NOT o THEN 'insert' WHEN NOT n THEN 'tombstone' ELSE 'update' END AS change FROM c WHERE (o OR n) AND (NOT o OR NOT n OR ch)""")
def changelog(spark, d):
    return R.changelog(*_states(spark, d), "b", F.lit(1).cast("long")).select("label", "key", F.col("props")["s"].alias("s"), "origin", "tombstone", "change")


def _log(spark, d):
    return table(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), "event_type")


_MARK = 1704900000


@query("pull_since", f"WITH e AS (SELECT epoch_us(ts) // 1000000 AS timestamp, lpad(CAST(event_id AS VARCHAR), 9, '0') AS id FROM events) SELECT timestamp, id FROM e WHERE timestamp > {_MARK}")
def pull(spark, d):
    marks = spark.createDataFrame([("p1", _MARK, "999999999"), ("p2", 5, "a")], "peer string, timestamp long, id string")
    return R.pull_since(_log(spark, d), marks, "p1")[0].select("timestamp", "id")


@query("pull_marks", "WITH e AS (SELECT epoch_us(ts) // 1000000 AS timestamp, lpad(CAST(event_id AS VARCHAR), 9, '0') AS id FROM events) SELECT 'p1' AS peer, max((timestamp, id))[1] AS timestamp, max((timestamp, id))[2] AS id FROM e UNION ALL SELECT 'p2', 5, 'a'")
def marks(spark, d):
    marks = spark.createDataFrame([("p1", _MARK, "999999999"), ("p2", 5, "a")], "peer string, timestamp long, id string")
    return R.pull_since(_log(spark, d), marks, "p1")[1]


@query("version_vectors", """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT key, CASE WHEN (v > c) AND (e < c) THEN 'concurrent' WHEN (v < c) AND (e > c) THEN 'concurrent' WHEN v = c AND e = c THEN 'equal' WHEN v >= c AND e >= c THEN 'after' ELSE 'before' END AS relation FROM n""")
def vectors(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "error")])
    both = lambda a, b: n.select("key", F.create_map(F.lit("x"), F.col(a), F.lit("y"), F.col(b)).alias("version_vector"))
    return R.compare_vectors(both("view", "error"), both("click", "click"))


@query("partition_copy", """SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN bool_or(event_type = 'view') THEN 'local' ELSE 'b' END AS synced_from, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""".replace("count(*) AS n", "1 AS n"))
def partition_copy(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("partition_key")).distinct()
    dst = e.filter("partition_key = 'view'").withColumns({"synced_from": F.lit("local"), "synced_at": F.lit("t0")})
    return R.copy_partition(e, dst, "click", "b", F.lit("t1")).select("key", "synced_from", F.lit(1).alias("n"))


@query("sync_lag", "SELECT event_type AS origin, count(*) AS n, 1706745600 - max(epoch_us(ts) // 1000000) AS lag_s FROM events GROUP BY 1")
def lag(spark, d):
    return R.lag(_log(spark, d).withColumnRenamed("event_type", "origin"), F.lit(1706745600).cast("long"))


@query("sync_counters", "SELECT CAST(user_id % 5 AS VARCHAR) AS peer, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n, CAST(sum(event_id % 10) AS BIGINT) AS sent, CAST(sum(event_id % 7) AS BIGINT) AS received FROM events GROUP BY 1, 2")
def counters(spark, d):
    e = table(spark, d, "events").select(
        (F.col("user_id") % 5).cast("string").alias("peer"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), (F.col("event_id") % 10).alias("sent"), (F.col("event_id") % 7).alias("received")
    )
    return M.sync_counters(e)
