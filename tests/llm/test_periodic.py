"""Runs against brute force, and what is planted against its rule."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewell.llm import periodic
from tracewell.llm.periodic import LastEnds, SuffixAutomaton, best_run, op11_periodic_runs, periodic_runs, runs_of, with_planted_runs

DIR = "/root/testdata/sf0.001"


def expected(w, least=6, exponent=4):
    """All runs, period by period; a stretch counts for its smallest one."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            e = i
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            s = i - q
            if e - s >= max(least, exponent * q) and (s, e - s) not in out:
                out[s, e - s] = q
            i = e
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def found(rows, least=6, exponent=4):
    """Runs by way of stretches, as a task finds them."""
    import pyarrow as pa

    run, _ = periodic._find("bigint", least, exponent)
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["id", "text"])
    out = [r for x in run(iter([b])) for r in x.to_pylist()]
    return [[(r["start"], r["length"], r["period"]) for r in x["runs"]] for x in out], out


texts = st.lists(st.tuples(st.sampled_from(["a", "ab", "abc", "aab", "abcab", "x", "abab", "é b", "wxyzv"]), st.integers(1, 7)), max_size=8)


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from([(6, 4), (2, 2), (5, 3), (9, 2), (1, 5)]))
def test_runs(parts, limits):
    w = [c for p, k in parts for c in p * k if c != " "]
    assert runs_of(w, *limits) == expected(w, *limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=5), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_stretches_hold_all_runs(many, limits):
    rows = [" ".join(c for p, k in parts for c in p * k if c != " ") for parts in many]
    assert found(rows, *limits)[0] == [expected(r.split(), *limits) for r in rows]


def test_random_texts():
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        w = []
        while len(w) < rng.choice([0, 20, 400]):
            block = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 20]))]
            w += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randrange(len(block))]
        rows.append(" ".join(w))
    assert found(rows)[0] == [expected(r.split()) for r in rows]


def test_access_knows_last_ends():
    rng = random.Random(9)
    for _ in range(50):
        w = [rng.choice("ab") for _ in range(60)]
        automaton = SuffixAutomaton(w)
        tree = LastEnds(automaton)
        for i, state in enumerate(automaton.ends):
            most = {}
            for n, before in tree.access(state, i):
                most[before] = max(n, most.get(before, 0))
            want = {}
            for n in range(1, i + 1):
                before = max((j for j in range(n - 1, i) if w[j - n + 1 : j + 1] == w[i - n + 1 : i + 1]), default=None)
                if before is not None:
                    want[before] = n
            assert most == want


def test_long_texts():
    same = " ".join(["w"] * 60_000)
    rng = random.Random(2)
    block = [str(rng.randrange(10**6)) for _ in range(9_000)]
    long = " ".join(["start", *block * 4, "end"])
    rows = [same, long, None, "", " \t\n"]
    runs, out = found(rows)
    assert runs == [[(0, 60_000, 1)], [(1, 36_000, 9_000)], [], [], []]
    assert [x["collapsed"] for x in out] == ["w", " ".join(["start", *block, "end"]), "", "", ""]


def test_overlapping_runs_and_ties():
    w = "a b a b a b a b b b b b b c c c c c c d".split()
    runs = runs_of(w)
    assert runs == expected(w) == [(0, 8, 2), (7, 6, 1), (13, 6, 1)] and best_run(runs) == (7, 6, 1)
    assert best_run([(0, 8, 2), (3, 12, 3), (9, 16, 4)]) == (0, 8, 2) and best_run([]) is None
    assert periodic._collapsed([x.encode() for x in w], runs) == b"a b c d".split()


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w, False
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], True


def test_planting_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 3, 7, 50]))), 7) for i in range(-20, 300)]
    rows += [(None, "a a a a a a", 1), (5, None, 1), (6, "", 1), (7, " \t\x0b ", 1), (8, "x\ny  z", 1), (8, "x\ny  z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").withColumns({c: F.lit(3) for c in ("_words", "_hash", "id", "runs", "best")})
    edited = with_planted_runs(df)
    assert edited.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in edited.collect()), key=str)
    want = []
    for i, t, _ in rows:
        w, did = planted(i, t)
        want.append((i, " ".join(w) if did else t))
    assert got == sorted(want, key=str) and sum(planted(i, t)[1] for i, t, _ in rows) > 20
    out = periodic_runs(edited).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["n_words"], r["collapsed"]): r for r in out}
    assert by[None, 6, "a"]["runs"] == [(0, 6, 1)] and by[5, 0, ""]["best"] is None and by[8, 3, "x y z"]["runs"] == []
    assert periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, DIR).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        w, _ = planted(r["doc_id"], r["text"])
        ids = np.unique(w, return_inverse=True)[1].tolist() if w else []
        runs = expected(ids) if len(w) < 1500 else runs_of(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        g, best = got[r["doc_id"]], best_run(runs)
        assert (g["n_runs"], g["runs_sha256"]) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))
        assert g["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        assert (g["start"], g["length"], g["period"], g["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
