"""Stored tables under new checkpoints, and merged state over restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import reconcile as R
from tracewell.sources.changelog import pull_stream
from tracewell.streaming import streams as T
from tracewell.streaming.versions import merge_version, sighted_version

JOBS = "label string, key string, props map<string,string>, seq long"
VERSION = "entity_type string, key string, props map<string,string>, origin string, timestamp long, version long, tombstone boolean, seq long"


def _jobs(spark, path, names, seq):
    spark.createDataFrame([("N", k, {"p": f"{k}{seq}"}, seq) for k in names], JOBS).coalesce(1).write.mode("append").parquet(path)
    return T.read_jobs(spark, path, spark.createDataFrame([], JOBS).schema)


def test_a_new_checkpoint_keeps_the_table(spark, tmp_path):
    t = str(tmp_path / "t")
    first, second = [f"k{i}" for i in range(5)], [f"n{i}" for i in range(5)] + ["k0"]
    T.stream_upsert(_jobs(spark, str(tmp_path / "a"), first, 1), t, str(tmp_path / "c1"), buckets=4).awaitTermination()
    T.stream_upsert(_jobs(spark, str(tmp_path / "b"), second, 2), t, str(tmp_path / "c2")).awaitTermination()
    got = {r["key"]: r["props"]["p"] for r in T.latest(spark, t, T.NODES).collect()}
    assert got == {k: f"{k}1" for k in first} | {k: f"{k}2" for k in second}
    T.stream_upsert(_jobs(spark, str(tmp_path / "a"), ["late"], 3), t, str(tmp_path / "c1")).awaitTermination()  # the first one goes on
    assert {r["key"] for r in T.latest(spark, t, T.NODES).collect()} == {*first, *second, "late"}
    assert max(T._versions(spark, t)) < 4


def test_new_rows_and_counts_under_new_checkpoints(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i, f"e{i % 2}") for i in ids], "user_id long, event_type string")
    t, pairs = str(tmp_path / "t"), str(tmp_path / "p")
    for n, ids in enumerate([range(5), range(3, 9)]):
        path = str(tmp_path / f"in{n}")
        rows(ids).coalesce(1).write.parquet(path)
        s = T.read_jobs(spark, path, rows([]).schema)
        T.stream_new_only(s, t, str(tmp_path / f"c{n}"), ["user_id"]).awaitTermination()
        T.stream_pair_counts(s, ["user_id", "event_type"], pairs, str(tmp_path / f"d{n}")).awaitTermination()
    assert sorted(r["user_id"] for r in spark.read.parquet(t).collect()) == list(range(9))
    assert sum(r["count"] for r in T.latest(spark, pairs, T.PAIRS).collect()) == 11


def _log(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        props = {"count": rng.choice(["1", "2", "x"]), "first_seen": str(rng.randrange(99)), "note": f"n{i}"} | ({"context": f"c{i}"} if rng.random() < 0.5 else {})
        rows.append((rng.choice(["sighting", "user", None]), f"k{rng.randrange(5)}", props, rng.choice("ab"), rng.randrange(9), i, rng.random() < 0.04, i))
    return rows


def _flat(df):
    return sorted(str((r["entity_type"], r["key"], sorted(r["props"].items()), r["origin"], r["timestamp"], r["version"], r["tombstone"], r["seq"])) for r in df.collect())


def test_merged_state_over_a_restart(spark, tmp_path):
    rows, rules = _log(2, 90), {"sighting": "sighting"}
    path, check = str(tmp_path / "in"), str(tmp_path / "c")
    random.Random(5).shuffle(rows)
    for part in (rows[:40], rows[40:]):  # the second run goes on from the state of the first
        spark.createDataFrame(part, VERSION).coalesce(2).write.mode("append").parquet(path)
        s = T.read_jobs(spark, path, spark.createDataFrame([], VERSION).schema, 1)
        T.stream_merge(s, rules, check).awaitTermination()
    good = R.split_mergeable(spark.createDataFrame(rows, VERSION))[0]
    assert _flat(T.merged_state(spark, check)) == _flat(R.merge(good, rules))


def test_tombstones_are_forgotten(spark, tmp_path):
    rows = [("user", "a", {"x": "1"}, "o", 1, 1, False, 1), ("user", "b", {"x": "1"}, "o", 2, 2, True, 2)]
    path, check = str(tmp_path / "in"), str(tmp_path / "c")
    spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(path)
    s = T.read_jobs(spark, path, spark.createDataFrame([], VERSION).schema)
    with pytest.raises(ValueError):
        T.stream_merge(s, {}, check, expire_ms=1)
    q = T.stream_merge(s, {}, check, interval="1 second", expire_ms=1500)
    try:
        end = time.time() + 90
        while time.time() < end and q.isActive and not ((p := q.lastProgress) and p["batchId"] >= 5):
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    assert [r["key"] for r in T.merged_state(spark, check).collect()] == ["a"]


def test_states_don_t_depend_on_the_order():
    versions = [dict(zip(("props", "origin", "timestamp", "version", "tombstone", "seq"), r[2:])) for r in _log(3, 30)]
    fields = R.SIGHTING_RULE
    seen = set()
    for seed in range(5):
        random.Random(seed).shuffle(versions)
        state = None
        for v in versions:
            state = merge_version(state, v, fields)
        seen.add(str((sorted(sighted_version(state, fields)["props"].items()), state["winner"], state["dead"])))
    assert len(seen) == 1


def test_newest_values_of_one_time_and_origin(spark):
    """Streamed, merged and exchanged states agree on them, whatever came first."""
    rows = [("s", "k", {"context": c}, "a", 1, i, False, i) for i, c in enumerate("yzx")]
    for log in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        df, state = spark.createDataFrame(log, VERSION).coalesce(1), None
        for r in log:
            state = merge_version(state, dict(zip(("props", "origin", "timestamp", "version", "tombstone", "seq"), r[2:])), R.SIGHTING_RULE)
        assert sighted_version(state, R.SIGHTING_RULE)["props"]["context"] == "z"
        assert R.merge(df, {"s": "sighting"}).first()["props"]["context"] == "z"
        assert R.replica_state(df, {"s": "sighting"}).first()["props"]["context"] == "z"


def test_pulls_go_on_at_their_mark(spark, tmp_path):
    """Entries that share a timestamp, in files of any order: none is lost or repeated over a restart."""
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "c"))

    def add(entries):
        spark.createDataFrame(entries, "timestamp long, id string, v string").repartition(2).write.mode("append").parquet(log)

    def run():
        s = pull_stream(spark, log, (5, "b"))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["v"] for r in spark.read.schema(s.schema).parquet(out).collect())

    add([(4, "z", "old"), (5, "a", "old"), (5, "b", "old"), (5, "c", "1"), (7, "a", "2"), (7, "b", "3"), (None, "x", "no"), (6, None, "no")])
    assert run() == ["1", "2", "3"] and run() == ["1", "2", "3"]
    add([(7, "c", "4"), (7, "d", "5"), (9, "a", "6")])
    assert run() == ["1", "2", "3", "4", "5", "6"]
