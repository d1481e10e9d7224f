"""Streams over the same operators (T1-T6). Each starts a query and returns it.

Merged entity versions (T5) are the query's own state, in RocksDB. Other tables are Parquet below ``table``, in buckets by a hash of
their key. A batch writes the buckets that it touches, whole, to a folder of its own, and leaves all others where they are; so a batch
costs the buckets it touches. Folders are numbered on, and named by the query (as its checkpoint knows it) and the batch: a batch that runs
again writes the same folder again, and a query with another checkpoint goes on from what is there. Of each bucket the newest version and
the one that a retry would need are kept, older ones are deleted. A table has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracewell.operators.enrich import enrich_asn, enrich_geo, flag_blocklist
from tracewell.operators.graph import add_counts, new_only, upsert_versions
from tracewell.operators.reconcile import SIGHTING_RULE, split_mergeable
from tracewell.streaming.versions import VERSION_FIELDS, merge_version, plain as _plain, sighted_version

NODES = "label string, key string, props map<string,string>, seqs map<string,bigint>"
PAIRS = "a_key string, b_key string, count bigint, last_seen timestamp"
BUCKETS = 64


def _listed(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []


def _run(spark: SparkSession, checkpoint: str) -> str:
    """The name of the query that has this checkpoint, the same after a restart."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"].replace("-", "")[:12]


def _number(name: str) -> int:
    return int(name[2:].split("_")[0])


def _folder(spark: SparkSession, table: str, checkpoint: str, batch_id: int) -> str:
    """The folder of a batch: the one that it had before, or the next number."""
    run = _run(spark, checkpoint)
    names = [p.getName() for p in _listed(spark, table)[1] if p.getName().startswith("v=")]
    mine = [n for n in names if n.endswith(f"_{run}_{batch_id}")]
    return mine[0] if mine else f"v={max(map(_number, names), default=-1) + 1:09d}_{run}_{batch_id}"


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """For each bucket the numbers of the batches that wrote it, with its folder, the oldest first; only finished batches count."""
    fs, batches = _listed(spark, table)
    out: dict[int, list[tuple[int, str]]] = {}
    for path in batches:
        name = path.getName()
        if name.startswith("v=") and fs.exists(path.suffix("/_SUCCESS")) and (before is None or _number(name) < before):
            for part in _listed(spark, str(path))[1]:
                if part.getName().startswith("b="):
                    out.setdefault(int(part.getName()[2:]), []).append((_number(name), str(part)))
    return {b: sorted(v) for b, v in out.items()}


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest(spark: SparkSession, table: str, schema, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The newest version of a table, or the newest before a number, or some of its buckets; empty if there is none."""
    found = _versions(spark, table, before)
    return _read(spark, [v[-1][1] for b, v in found.items() if buckets is None or b in buckets], schema)


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _layout(spark: SparkSession, table: str, buckets: int) -> int:
    """The number of buckets of a table, that of its first batch."""
    fs, found = _listed(spark, table)
    for path in found:
        if path.getName().startswith("buckets="):
            return int(path.getName()[8:])
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/buckets={buckets}"))
    return buckets


def _write(folder: str, df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    out = df.withColumn("b", _bucket(keys, buckets)).repartition(buckets, "b")
    out.write.mode("overwrite").partitionBy("b").parquet(f"{table}/{folder}")


def _drop_old(spark: SparkSession, table: str, number: int) -> None:
    """Delete what no reader of the newest version and no retry of this batch needs."""
    fs, _ = _listed(spark, table)
    for found in _versions(spark, table, number).values():
        for _, path in found[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _merge_into(
    batch: DataFrame, batch_id: int, table: str, checkpoint: str, schema, keys: list[str], f: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> None:
    """The touched buckets of a table, replaced by ``f(stored, batch)``."""
    spark = batch.sparkSession
    n, folder = _layout(spark, table, buckets), _folder(spark, table, checkpoint, batch_id)
    touched = {r[0] for r in batch.select(_bucket(keys, n)).distinct().collect()}  # a number a bucket
    _write(folder, f(latest(spark, table, schema, _number(folder), touched), batch), table, keys, n)
    _drop_old(spark, table, _number(folder))


def _start(stream: DataFrame, checkpoint: str, each, interval: str | None):
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def read_jobs(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """The stream of a folder of Parquet files, ``max_files`` a batch at most: T1's limit by size, as its interval is by time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def stream_upsert(stream: DataFrame, table: str, checkpoint: str, interval: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """``(label, key, props, seq)`` jobs merged into a node table, a batch at a time; a later sequence wins in whatever batch it comes.

    ``buckets`` is the number of parts of a new table, some gigabytes each at its full size; one that is there keeps its own.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        _merge_into(batch, batch_id, table, checkpoint, NODES, ["label", "key"], upsert_versions, buckets)

    return _start(stream, checkpoint, each, interval)


def stream_with_rejects(stream: DataFrame, table: str, rejects: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """As T1; jobs without label, key or sequence go to ``rejects`` instead of failing their batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ok = F.col("label").isNotNull() & F.col("key").isNotNull() & F.col("seq").isNotNull()
        batch.filter(~ok).write.mode("overwrite").parquet(f"{rejects}/{_folder(batch.sparkSession, rejects, checkpoint, batch_id)}")
        _merge_into(batch.filter(ok), batch_id, table, checkpoint, NODES, ["label", "key"], upsert_versions)

    return _start(stream, checkpoint, each, interval)


def stream_new_only(
    stream: DataFrame, table: str, checkpoint: str, keys: list[str], within: str | None = None, time_col: str = "ts", interval: str | None = None
) -> StreamingQuery:
    """Rows whose provenance is new. With ``within`` by bounded state; without it by the stored table, exactly.

    Exactly means a join with the keys that are stored in the buckets of the batch; versions only add rows here.
    """
    if within:
        d = stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)
        w = d.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
    schema = stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        n, folder = _layout(spark, table, BUCKETS), _folder(spark, table, checkpoint, batch_id)
        touched = {r[0] for r in batch.select(_bucket(keys, n)).distinct().collect()}  # a number a bucket
        stored = [p for b, v in _versions(spark, table, _number(folder)).items() if b in touched for _, p in v]
        _write(folder, new_only(batch, _read(spark, stored, schema), keys), table, keys, n)

    return _start(stream, checkpoint, each, interval)


def stream_pair_counts(
    stream: DataFrame, columns: list[str], table: str, checkpoint: str, time_col: str | None = None, interval: str | None = None
) -> StreamingQuery:
    """T4: running counts of value pairs inside a row, in ``table`` as ``(a_key, b_key, count, last_seen)``."""
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(c), F.col(c).cast("string"))) for c in columns]))
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: x < y), lambda y: F.struct(x.alias("a_key"), y.alias("b_key")))))
    seen = (F.col(time_col) if time_col else F.lit(None)).cast("timestamp")

    def each(batch: DataFrame, batch_id: int) -> None:
        d = batch.withColumn("c", F.array_sort(F.array_distinct(cells))).select(F.explode(pairs).alias("p"), seen.alias("t"))
        d = d.groupBy("p.a_key", "p.b_key").agg(F.count("*").alias("count"), F.max("t").alias("last_seen"))
        _merge_into(d, batch_id, table, checkpoint, PAIRS, ["a_key", "b_key"], lambda old, new: add_counts(old, new, ["a_key", "b_key"]))

    return _start(stream, checkpoint, each, interval)


MERGED = "props map<string,string>, origin string, timestamp long, version long, tombstone boolean, seq long"


class _Merger(StatefulProcessor):
    """The merged version of each key as state, by the rules of R6, and a timer for tombstones."""

    def __init__(self, rules: dict[str, str], default: str, sighting_rule: dict[str, list[str]], expire_ms: int | None):
        self.rules, self.default, self.fields, self.expire_ms = rules, default, sighting_rule, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.merged = handle.getValueState("merged", "merged string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        state = json.loads(self.merged.get()[0]) if self.merged.exists() else None
        for frame in rows:
            for r in frame.to_dict("records"):
                state = merge_version(state, {n: _plain(r[n]) for n in VERSION_FIELDS}, self.fields)
        sighted = self.rules.get(key[0], self.default) == "sighting" and not state["dead"]
        state["out"] = sighted_version(state, self.fields) if sighted else state["winner"]
        self.merged.update((json.dumps(state),))
        if self.expire_ms is not None and state["out"]["tombstone"]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield pd.DataFrame({"entity_type": [key[0]], "key": [key[1]], **{n: [state["out"][n]] for n in VERSION_FIELDS}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.merged.exists() and json.loads(self.merged.get()[0])["out"]["tombstone"]:
            self.merged.clear()
        return iter(())


def stream_merge(
    stream: DataFrame, rules: dict[str, str], checkpoint: str, interval: str | None = None, default: str = "last_writer_wins",
    sighting_rule: dict[str, list[str]] = SIGHTING_RULE, expire_ms: int | None = None, sink: str = "noop",
) -> StreamingQuery:
    """T5: entity versions merged by the rules of R6, in the query's state: each version is read once, and a batch costs the keys it has.

    :func:`merged_state` reads the table from the checkpoint; what changes goes to ``sink``. With ``expire_ms`` a tombstone is forgotten after so
    long without a new version, by a timer, so deleted keys don't stay for ever; an older version that comes later still is new then.
    Timers only go off while the query runs, so they need an ``interval``. Versions without type or key are left out (R10).
    """
    if expire_ms is not None and interval is None:
        raise ValueError("timers need an interval")
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = split_mergeable(stream)[0].groupBy("entity_type", "key").transformWithStateInPandas(
            _Merger(rules, default, sighting_rule, expire_ms), f"entity_type string, key string, {MERGED}", "Update", "None" if expire_ms is None else "ProcessingTime"
        )
        w = out.writeStream.format(sink).outputMode("update").option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(setting, before)


def merged_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table that :func:`stream_merge` has come to, read from its state."""
    d = spark.read.format("statestore").option("stateVarName", "merged").load(checkpoint)
    v = F.from_json("value.merged", T.StructType([T.StructField("out", T._parse_datatype_string(MERGED))]))
    return d.select("key.entity_type", "key.key", v.alias("v")).select("entity_type", "key", "v.out.*")


def stream_enrich(stream: DataFrame, reference: DataFrame, kind: str, table: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Values enriched from a static table: ``geo``, ``asn`` or ``blocklist``."""
    f = {"geo": enrich_geo, "asn": enrich_asn, "blocklist": flag_blocklist}[kind]

    def each(batch: DataFrame, batch_id: int) -> None:
        f(batch, reference).write.mode("overwrite").parquet(f"{table}/{_folder(batch.sparkSession, table, checkpoint, batch_id)}")

    return _start(stream, checkpoint, each, interval)
