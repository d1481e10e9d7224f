"""Golden cases of privacy, graph, merge and streams; the registered queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.operators import components, graph as G, privacy as P, reconcile as R
from tracewell.operators.components import connected_components
from tracewell.operators.ordering import with_running
from tracewell.plans.queries import ORACLE, QUERIES
from tracewell.scratch import cut
from tracewell.streaming import streams as T

KEY = b"\x42" * 32


def version(key, origin, ts, tombstone=False, seq=0, kind="t", **props):
    return (kind, key, {k: str(v) for k, v in props.items()}, origin, ts, 1, tombstone, seq)


SCHEMA = "entity_type string, key string, props map<string,string>, origin string, timestamp long, version long, tombstone boolean, seq long"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_last_writer_and_tombstones(spark):
    got = R.merge_lww(frame(spark, version("a", "node1", 1500), version("a", "node2", 1400, seq=1), version("b", "node_a", 1000), version("b", "node_z", 1000, seq=1))).collect()
    assert {r["key"]: r["origin"] for r in got} == {"a": "node1", "b": "node_z"}
    for flip in (0, 1):
        rows = [version("a", "x", 1000, seq=flip), version("a", "y", 500, True, seq=1 - flip), version("a", "z", 900, True, seq=3)]
        r = R.merge_tombstone(frame(spark, *rows)).first()
        assert r["tombstone"] and r["timestamp"] == 900


def test_heavy_pairs_are_exact(spark):
    rows = [("d", i, "c", key, 0) for i in range(2000) for key in (f"a{i * 7 % 2000:05d}|x", f"b{i * 7 % 2000:05d}")]
    cells = spark.createDataFrame(rows, "dump_id string, row_index long, column string, canonical_key string, ts long")
    got = [tuple(r) for r in G.heavy_pairs(cells, 2).collect()]
    assert got == [("a00000|x", "b00000", 1), ("a00001|x", "b00001", 1)]


def test_sightings(spark):
    rows = [version("k", "n1", 1500, seq=0, count=10, first_seen=1000, last_seen=1500, context="A", location="L"), version("k", "n2", 1600, seq=1, count=5, first_seen=1100, last_seen=1700, context="B", location="M")]
    p = R.merge_sightings(frame(spark, *rows)).first()["props"]
    assert p == {"count": "15", "first_seen": "1000", "last_seen": "1700", "context": "B", "location": "L"}
    more = [*rows, version("k", "n3", 1400, seq=2, count=30, last_seen="not a time")]
    for _ in range(3):
        random.shuffle(more)
        assert R.merge_sightings(frame(spark, *more)).first()["props"]["count"] == "45"


def test_encryption(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("é" * 1000,)], "v string")
    sealed = cut(P.encrypt_values(df, "v", KEY, "k1"), "t-sealed")
    plain, audit = P.decrypt_values(sealed, "envelope", {"k1": KEY}, "me", "why", "v")
    assert all(r["plain"] == r["v"] for r in plain.collect()) and audit.count() == 3
    wrong, audit = P.decrypt_values(sealed, "envelope", {"k1": b"\x00" * 32}, "me", "why", "v")
    assert {r["plain"] for r in wrong.collect()} == {None} and {r["status"] for r in audit.collect()} == {"refused"}
    _, audit = P.decrypt_values(sealed, "envelope", {"k9": KEY}, "me", "why", "v")
    assert {r["status"] for r in audit.collect()} == {"unknown_key"}
    assert {r["state"] for r in P.protection_state(sealed, "envelope").collect()} == {"encrypted", None}


def test_policy_falls_back_to_redaction(spark):
    df = spark.createDataFrame([("email", "a@b.c"), ("ssn", "1"), ("password", "p"), ("x", "y"), ("email", None)], "f string, v string")
    rules = {"email": "hash", "ssn": "encrypt", "password": "scrub"}
    got = {(r["f"], r["v"]): r["protected"] for r in P.apply_policy(df, "f", "v", rules).collect()}
    assert len(got["email", "a@b.c"]) == 71 and got["ssn", "1"] == got["password", "p"] == "[REDACTED]" and got["x", "y"] == "y" and got["email", None] is None


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("A", "1", {"x": "0", "y": "0"}), ("B", "1", {})], "label string, key string, props map<string,string>")
    jobs = spark.createDataFrame([("A", "1", {"x": "1"}, 1), ("A", "1", {"x": "2", "y": None}, 2), ("C", "9", {"z": "1"}, 3)], "label string, key string, props map<string,string>, seq long")
    once = G.upsert_props(base, jobs)
    show = lambda df: {(r["label"], r["key"]): r["props"] for r in df.collect()}
    assert show(once) == {("A", "1"): {"x": "2"}, ("B", "1"): {}, ("C", "9"): {"z": "1"}} == show(G.upsert_props(once, jobs))


def test_stored_upserts_in_any_order(spark):
    rows = [("A", "1", {"x": "new"}, 5), ("A", "1", {"x": "old", "y": "1"}, 3), ("A", "1", {"y": None}, 4), ("B", "2", {}, 1), ("A", "1", {"z": None}, 9), ("A", "1", {"z": "late"}, 8)]
    schema = "label string, key string, props map<string,string>, seq long"
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        base = spark.createDataFrame([], T.NODES)
        for job in order:
            base = cut(G.upsert_versions(base, spark.createDataFrame([job], schema)), "t-upsert")
        assert {(r["label"], r["key"]): r["props"] for r in base.collect()} == {("A", "1"): {"x": "new"}, ("B", "2"): {}}


def test_streamed_upsert_out_of_order(spark, tmp_path):
    schema = "label string, key string, props map<string,string>, seq long"
    for n, job in enumerate([("A", "1", {"x": "new"}, 5), ("A", "1", {"x": "old"}, 3), ("A", "2", {"x": "b"}, 1), ("A", "1", {"y": "c"}, 4)]):
        spark.createDataFrame([job], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        T.stream_upsert(T.read_jobs(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {r["key"]: r["props"] for r in T.latest(spark, str(tmp_path / "t"), T.NODES).collect()} == {"1": {"x": "new", "y": "c"}, "2": {"x": "b"}}
    kept = [v for v in T._versions(spark, str(tmp_path / "t")).values()]
    assert sorted(len(v) for v in kept) == [1, 2]  # the newest, and the one before it for a retry


def test_samples_are_the_smallest(spark):
    cells = spark.createDataFrame([("d", i, c, c, None) for i in range(40) for c in ("a", "b")], "dump_id string, row_index long, column string, canonical_key string, ts timestamp").repartition(7)
    r = G.pair_edges(cells, [("t", "a", "b")]).first()
    assert r["count"] == 40 and r["samples"] == [f"d:{i:012d}" for i in range(5)]


def test_sweep_at_any_depth(spark):
    deep = '{"x":' * 30 + '{"name":"plain"}' + "}" * 30
    df = spark.createDataFrame([(deep,), ('[{"secret":"sha256:' + "0" * 64 + '"}]',), ('{"secret":""}',), ("broken",), (None,)], "doc string")
    got = {(r["path"].count("."), r["field"], r["state"]) for r in P.sweep_plaintext(df, {"name": "hash", "secret": "scrub"}, ("doc",)).collect()}
    assert got == {(31, "name", "plain"), (2, "secret", "hashed"), (1, "secret", "plain")}
    assert P.sweep_plaintext(df, {}, ("doc",)).count() == 0


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr("tracewell.operators.components.LEAST_DEGREE", 5)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1000 + i + 1) for i in range(30)] + [(399, 2000)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: 0 if v < 1000 or v == 2000 else 1000 for e in edges for v in e}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 2000), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_finished_components_take_no_round(spark, monkeypatch):
    """Stars around their least vertex are components already, a path isn't, and neither is a star around another vertex."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))

    def found(edges):
        rounds.clear()
        return {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}

    assert found([(1, i) for i in range(2, 30)] + [(50, 51), (51, 50), (7, 7), (60, 60)]) == {i: 1 for i in range(1, 30)} | {50: 50, 51: 50, 60: 60}
    assert not rounds
    assert found([(9, i) for i in range(5, 9)]) == {i: 5 for i in range(5, 10)} and rounds
    assert found([(i, i + 1) for i in range(9)]) == {i: 0 for i in range(10)} and rounds


def _roots_of(edges):
    """Components by union-find, named by their least vertex."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("name", [int, lambda i: f"v{i}"])
def test_components_of_many_forms(spark, monkeypatch, name):
    """Hubs with leaves and with links, paths, pairs, cliques, loops and repeats, as numbers and as names; of names, two have one hash at first."""
    monkeypatch.setattr("tracewell.operators.components.LEAST_DEGREE", 5)
    number, seeds = components._number, []
    monkeypatch.setattr(components, "_number", lambda c, seed: seeds.append(seed) or (number(c, seed) if seed else F.length(c).cast("long")))
    rng = random.Random(8)
    edges = [(7000, i) for i in range(7001, 7200)] + [(7100, 7300), (7300, 7301)] + [(i, i + 1) for i in range(300, 340)] + [(8000 + 2 * i, 8001 + 2 * i) for i in range(90)]
    edges += [(9000 + i, 9000 + j) for i in range(12) for j in range(i)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(400)] + [(6000, 6000), (7000, 7001), (7001, 7000)]
    edges = [(name(a), name(b)) for a, b in edges]
    t = spark.createDataFrame([*edges, (None, edges[0][0])], f"src {'long' if name is int else 'string'}, dst {'long' if name is int else 'string'}").repartition(3)
    rows = connected_components(t).collect()
    assert {r["vertex"]: r["component"] for r in rows} == _roots_of(edges) and len(rows) == len({v for e in edges for v in e})
    assert set(seeds) == (set() if name is int else {0, 1})


def test_rounds_read_less_and_less(spark, monkeypatch):
    """Orders with lines of which few are shared: after the first round only the shared ones are read, and dense pairs shrink as well."""
    made, cut = {}, components.cut
    count = lambda df, name: made.update({name: (r := cut(df, name)).count()}) or r
    monkeypatch.setattr(components, "cut", count)
    rng = random.Random(2)
    for edges, least in (([(f"o{rng.randrange(500)}", f"p{rng.randrange(20_000)}") for _ in range(2000)], 1), ([(rng.randrange(400), rng.randrange(400)) for _ in range(2000)], 2)):
        made.clear()
        df = spark.createDataFrame(edges, f"src {'string' if least == 1 else 'long'}, dst {'string' if least == 1 else 'long'}")
        assert {r["vertex"]: r["component"] for r in connected_components(df).collect()} == _roots_of(edges)
        rounds = [made[n] for n in made if n.removeprefix("cc-").isdigit()]
        assert len(rounds) >= least and sum(rounds) < 2000 and rounds == sorted(rounds, reverse=True) and rounds[-1] == 0


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(2).alias("w")).repartition(5)
    rows = with_running(df, [F.col("x")], "r", {"s": "w"}).collect()
    assert all(r["r"] == r["x"] + 1 and r["s"] == 2 * r["r"] for r in rows) and len(rows) == 1000


def test_co_occurrence_counts(spark):
    cells = spark.createDataFrame(
        [("d", i, c, f, None) for i in range(2) for c, f in (("e", "a"), ("p", "b"), ("e", "a"))], "dump_id string, row_index long, canonical_key string, column string, ts timestamp"
    )
    assert [(r["a_key"], r["b_key"], r["count"]) for r in G.co_occurs(cells).collect()] == [("e", "p", 2)]
    e = G.co_occurs(cells)
    assert G.add_counts(e, e, ["a_key", "b_key"]).first()["count"] == 4


TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    d = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, d).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
