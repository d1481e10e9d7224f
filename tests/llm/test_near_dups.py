"""Links and components against brute force."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewell.llm import near_dups as N

SCHEMA = "doc_id long, text string, n string"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, part=80, whole=100):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(ids[find(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n // 6):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for c in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((1000 - len(rows), " ".join(w).upper() if c == 1 else "\n".join([" ".join(w)])))
    return rows + [(5, ""), (6, None), (7, " \n\t "), (8, "one two"), (9, "One  TWO"), (10, "É x"), (11, "é x")]


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"limit": 3, "cluster_limit": 4, "max_depth": 2})])
def test_against_brute_force(spark, seed, limits):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = N.near_duplicates(df, shingle=4, **limits).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_what_a_large_node_ships(spark):
    """Five thousand sets in one node: a row each, and few more; the sets not linked to most meet all the others."""
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("node"), F.col("id").alias("key"), F.lit(5000).cast("long").alias("n"))
    groups = N._with_pivots(rows, 1024).collect()
    assert {r["key"] for r in groups} == set(range(5000)) and len(groups) <= 5000 + N.PIVOTS * 10
    sizes = Counter(r["group"] for r in groups)
    assert len(sizes) == 10 and max(sizes.values()) < 700
    found = rows.filter("key >= 3").select(F.col("key").alias("vertex"), F.lit(3).cast("long").alias("component"))
    rest, sparse = N._left_over(rows, found, 1024)
    groups = rest.collect()
    assert sparse.isEmpty()
    meets = {}
    for r in groups:
        meets.setdefault(r["group"], set()).add(r["key"])
    for k in (0, 1, 2):
        assert set().union(*(m for m in meets.values() if k in m)) == set(range(5000))
    assert len(groups) <= 5000 + 3 * 10
    rest, sparse = N._left_over(rows, rows.select(F.col("key").alias("vertex"), F.lit(0).cast("long").alias("component")), 1024)
    assert rest.isEmpty() and sparse.isEmpty()


def test_a_large_node_without_links_ships_in_proportion(spark):
    """Sets that share two thirds of their tokens and are linked with none: what is compared grows with their number."""
    shipped = {}
    for n in (1500, 6000):
        rows = spark.range(n).select(F.lit(7).cast("long").alias("node"), F.col("id").alias("key"), F.lit(n).cast("long").alias("n"))
        none = spark.createDataFrame([], "vertex long, component long")
        rest, sparse = N._left_over(rows, none, 1024)
        assert rest.isEmpty() and sparse.count() == n
        own = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.lit(10**6) + 10 * F.floor(F.col("key") / F.when(F.col("key") < 40, 2).otherwise(1)) + i + F.when(F.col("key") < 40, 0).otherwise(10**6))
        tokens = rows.select("key", F.concat(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("long")), own.cast("array<long>")).alias("tokens"))
        groups = N._by_rare_tokens(sparse, tokens, 80, 100, 1024).collect()
        shipped[n] = len(groups)
        meets = {}
        for r in groups:
            meets.setdefault(r["node"], set()).add(r["key"])
        assert all(any({2 * i, 2 * i + 1} <= m for m in meets.values()) for i in range(20))
    assert shipped[6000] <= 4 * shipped[1500] and shipped[6000] < 6000


@pytest.mark.parametrize("seed", [1, 2])
def test_one_long_passage_and_little_else(spark, seed):
    """Documents of one passage, most of them unlike, some near copies of each other, and many that share a second one."""
    rng = random.Random(seed)
    passage, second = [f"p{i}" for i in range(40)], [f"s{i}" for i in range(9)]
    rows = []
    for d in range(120):
        w = passage + [f"o{d}x{i}" for i in range(20)]
        if d % 3 == 0:
            w = passage + second + [f"o{d}x{i}" for i in range(11)]
        if d % 5 == 1:
            w = rows[-1][1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(100)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = N.near_duplicates(df, shingle=3, limit=8, cluster_limit=10, max_depth=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 3))


@pytest.mark.parametrize("seed", [3, 4])
def test_large_nodes_against_brute_force(spark, seed):
    """Near copies of two texts that share most of their words, and a chain of links away from them."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((d, " ".join(w)))
    chain = list(base)
    for d in range(60, 90):
        chain[d - 60] = f"y{d}"
        rows.append((d, " ".join(chain)))
    rows += [(100 + d, " ".join(base[: 40 + d])) for d in range(20)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = N.near_duplicates(df, shingle=3, limit=8, cluster_limit=10, max_depth=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 3))


def test_repeated_rows_null_ids_and_none(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(3, t, ""), (3, t, ""), (None, t, ""), (4, t + " h", ""), (3, "other words of its own here", "")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(df, shingle=4).collect()), key=str)
    assert got == sorted([(3, 3, True)] * 3 + [(None, 3, False), (4, 3, False)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=12))
def test_exact_links(sets):
    a, b = N.exact_links([np.array(sorted(s), np.uint64) for s in sets], 80, 100)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_whole_table_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    want = sorted(map(tuple, con.execute(N.OP2_SQL).fetchall()))
    assert sorted(tuple(r) for r in N.op2_minhash_near_dedup(spark, d).collect()) == want
