"""Phrase counts and collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import phrases
from tracewell.llm.phrases import PhraseTrie, _CLEAN, _count, collocations, op12_collocations, phrase_counts, worded

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    """``(counts by language and phrase, words by language)``."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def expected(rows, longest=3, least=10, share=50, top=2000):
    f, n = counted(rows, longest)
    frequent = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    longer = Counter()
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in frequent.items():
        if 100 * longer[lang, w] >= share * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank, rows = Counter(), set()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return rows


def made(seed, n=300):
    rng = random.Random(seed)
    vocab = ["New", "york", "CITY", "of", "the", "é", "日本", "a\x01", "x y"] + [f"w{i}" for i in range(12)]
    def text():
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(rng.choice([0, 1, 5, 40])))
    return [(rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text(), text(), text(), text() + "New York City", None])) for _ in range(n)]


@pytest.mark.parametrize("longest,most,burst", [(3, 10**6, 4096), (3, 200, 8), (2, 50, 2), (4, 300, 4)])
def test_trie_counts_whatever_spills_and_bursts(longest, most, burst):
    rows = made(longest * most)
    table = pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())})
    run, _ = _count(range(1, longest + 1), longest, most, burst)
    got, total, runs = Counter(), Counter(), 0
    for b in run(iter(table.to_batches(max_chunksize=37))):
        runs += 1
        for r in b.to_pylist():
            if r["phrase"]:
                got[r["lang"], tuple(r["phrase"].split(" "))] += r["count"]
            else:
                total[r["lang"]] += r["count"]
    f, n = counted(rows, longest)
    assert got == f and +total == +n
    assert most > 1000 or runs > 20


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 64)
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choice("ab  \n,") * rng.choice([1, 1, 1, 90]) for _ in range(rng.choice([0, 10, 300]))) for _ in range(4)]
        got = Counter()
        for words, piece, _, new in worded((t.encode().translate(_CLEAN) for t in texts), 3):
            trie = PhraseTrie(3)
            if words:
                trie.add(words, piece, new, range(1, 4))
            for b in trie.runs("x", 0):
                got.update({("x", tuple(p.split(" "))): c for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())})
        assert got == counted([("x", t) for t in texts], 3)[0]


def test_hashes_of_phrases_are_those_of_texts():
    words, piece, hashes, _ = next(worded(iter([b"a bb ccc dd e a bb"]), 3))
    rows = [b"a bb", b"bb ccc", b"ccc dd", b"dd e", b"e a", b"a bb"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 5 + ["y"]), pa.array([r.decode() for r in rows])], ["lang", "phrase"])
    got = [np.uint64(h) for b in phrases._hashed(2)(iter([batch])) for h in b.column(0).to_numpy().view(np.uint64)]
    want = phrases.phrase_hashes(hashes, 2, "x").tolist()
    assert got[:5] == want[:5] and want[5] == want[0] and got[5] != want[5]


def test_spill_takes_whole_subtrees_in_order():
    trie = PhraseTrie(3, burst=3)
    words = b"b a c b a d b a e a a a".split()
    trie.add(words, np.zeros(len(words), np.int64), 0, range(1, 4))
    before = trie.entries
    (first,) = [b.to_pylist() for b in trie.runs("x", before - 1)]
    names = [r["phrase"] for r in first]
    assert len({n.split(" ")[0] for n in names}) == 1 and names == sorted(names) and trie.entries == before - len(names)


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (3, 4, 7), (4, 10, 2000), (2, 2, 50)])
def test_collocations(spark, longest, least, top):
    rows = made(longest + least)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "words", "count", "a", "rank", "k")})
    got = collocations(df.repartition(5), longest, least, 50, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == expected(rows, longest, least, 50, top)


def test_large_counts_are_exact(spark):
    a, left, right = 9 * 10**14 + 7, 9 * 10**14 + 11, 9 * 10**14 + 13
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases._scores(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def test_edges(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations(none).count() == 0
    few = spark.createDataFrame([("en", "a b"), ("en", None), (None, ""), (None, " \t.,")], "lang string, text string")
    assert collocations(few).count() == 0
    assert {tuple(r) for r in phrase_counts(few).collect()} <= {("en", "", 0, 2), ("und", "", 0, 0)}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("lang", "text").collect()]
    assert {tuple(r) for r in op12_collocations(spark, DIR).collect()} == expected(rows)
