"""Operators whose plan is the point: blocks of pairs, sketches, buckets, observed counts, sweeps and classified reads."""

import itertools
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tracewell.operators import graph as G, graph_queries as Q, privacy as P, reports as M
from tracewell.sources import records as S


def test_overlap_in_blocks(spark):
    rng = random.Random(3)
    rows = [(f"d{i:03}", "all") for i in range(60)] + [(f"d{rng.randrange(60):03}", f"h{rng.randrange(30)}") for _ in range(200)]
    got = {(r["dump_a"], r["dump_b"]): r["shared"] for r in Q.dump_overlap(spark.createDataFrame(rows, "dump_id string, row_hash string"), 7).collect()}
    of = {}
    for d, h in set(rows):
        of.setdefault(h, set()).add(d)
    assert got == Counter(p for s in of.values() for p in itertools.combinations(sorted(s), 2))


def test_a_row_hash_in_very_many_dumps(spark):
    """Twenty thousand dumps: 200 million pairs, no row of which makes more than a block of them."""
    one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.format_string("d%05d", i)).alias("s"), F.lit(1).alias("n"))
    b = Q._block_pairs(one, 256)
    made = F.when(F.col("a") == F.col("b"), F.size("a") * (F.size("a") - 1) / 2).otherwise(F.size("a") * F.size("b"))
    r = b.agg(F.max(F.size("a") * F.size("b")).alias("most"), F.sum(made).alias("all"), F.count("*").alias("rows")).first()
    assert r["most"] <= 256 * 256 and r["all"] == 20_000 * 19_999 / 2 and r["rows"] == 79 * 80 / 2


def test_heavy_pairs_whatever_the_first_sketch(spark):
    rng = random.Random(11)
    cells = []
    for row in range(4000):
        a = int(rng.paretovariate(0.7)) % 500
        cells += [("d", row, 0, "x", f"x{a}"), ("d", row, 1, "y", f"y{a % 300}"), ("d", row, 2, "z", f"z{rng.randrange(2000)}")]
    df = spark.createDataFrame(cells, "dump_id string, row_index long, position int, column string, canonical_key string").withColumn("ts", F.lit(None).cast("timestamp"))
    want = [tuple(r) for r in G.co_occurs(df).select("a_key", "b_key", "count").orderBy(F.desc("count"), "a_key", "b_key").limit(8).collect()]
    for tracked, most in ((16, 65_536), (4096, 65_536), (16, 16)):  # widened, at once, not found
        assert [tuple(r) for r in G.heavy_pairs(df, 8, tracked, most).collect()] == want
    assert G.heavy_pairs(df.limit(0), 3).count() == 0


def test_lookup_reads_one_bucket(spark, tmp_path):
    nodes = spark.range(500).select(F.lit("User").alias("label"), F.col("id").cast("string").alias("key"), F.create_map(F.lit("p"), F.lit("v")).alias("props"))
    t = S.write_bucketed(nodes, "t_nodes_bucketed", "key", 16, str(tmp_path / "nodes"))
    found = Q.lookup(t, "User", "77")
    scan = found._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.optionalBucketSet().get().cardinality() == 1 and scan.relation().bucketSpec().get().numBuckets() == 16
    assert "EqualTo(key,77)" in found._jdf.queryExecution().toString()
    assert [r["key"] for r in found.collect()] == ["77"]
    spark.sql("DROP TABLE t_nodes_bucketed")


def test_observed_counters(spark):
    lines = ["ip,1.2.3.4", "broken", '{"type":"a","value":"b"}', ""]
    d, seen = M.observed_counters(S.parse_kv_lines(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert d.count() == 3
    assert seen.get == {"records": 3, "errors": 1, "bytes": sum(map(len, lines))}
    assert M.ingest_counters(d).first().asDict() == seen.get


def test_sweep_of_deep_and_repeated_members(spark):
    deep = "plain"
    for i in range(60):
        deep = {"name": deep} if i == 0 else ({"x": deep} if i % 2 else [deep])
    texts = [json.dumps(deep), '{"name": "a", "name": "b", "other": {"name": null, "secret": 5}}', "not json", "[1, 2]", None, '"name"', "[" * 5000 + "]" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    got = P.sweep_plaintext(df, {"name": "hash", "secret": "scrub"}, ("doc",)).collect()
    assert sorted(r["path"].count(".") for r in got) == [1, 1, 60] and {r["field"] for r in got} == {"name"}


def test_classified_reads(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, None, "t"), (None, "c", "u")], "id long, name string, seg string")
    none = spark.createDataFrame([], "field string, row long, level string")
    high = [(None, P.REDACTED, P.REDACTED), (None, None, P.REDACTED), (None, P.REDACTED, P.REDACTED)]
    assert [tuple(r) for r in P.classified_view(df, none, "confidential").collect()] == high
    assert [tuple(r) for r in P.classified_view(df, none, "high", "id").orderBy("seg").collect()] == [(1, "a", "s"), (2, None, "t"), (None, "c", "u")]
    some = spark.createDataFrame([("name", None, "public"), ("id", None, "public"), ("name", None, "internal"), ("seg", 2, "public"), (None, 1, "what"), ("gone", None, "public")], none.schema)
    got = P.classified_view(df, some, "internal", "id", "t_classified")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, P.REDACTED, P.REDACTED), (2, None, "t"), (None, "c", P.REDACTED)], key=str)
    assert spark.table("t_classified").count() == 3
