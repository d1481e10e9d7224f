"""Held-out accuracy, and the cases at the edges."""

import math
import zlib

import numpy as np
import pytest

from tracewell.llm.toxicity import PIECE, RATIO, SURE, _pair, _strings, document_counts, fit, leaning, learn, op7_toxicity, score, score_toxicity


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = learn(docs, labels)
    rows = score_toxicity(docs.join(labels, "doc_id"), model).filter("held_out").join(labels, "doc_id").collect()
    pos = [r["score"] for r in rows if r["toxic"]]
    neg = [r["score"] for r in rows if not r["toxic"]]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    right = sum((r["predicted"] == r["toxic"]) for r in rows) / len(rows)
    assert area > 0.9 and right > 0.93
    for r in rows[:50]:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (1, "word " * 50000, "w")], "doc_id long, text string, score string")
    for texts, y in ([], []), (["a"], [0]), (["you idiot", "fine day"], [1, 0]):
        rows = score_toxicity(df, fit(texts, y)).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 2} | {rows[0]["score"]}) == 1
    assert score_toxicity(df.limit(0), fit([], [])).count() == 0


def test_score_against_its_definition():
    """Windows, gains and the curve by hand; a quoted word in ordinary text doesn't hide it."""
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    text = lambda extra: " ".join([*rng.choice(vocab, 60), *extra])
    texts = [text(["vileword"] + ["nastyone"] * (k % 9 > 0)) for k in range(60)] + [text([]) for _ in range(240)] + [text(["vileword"])]
    y = [1] * 60 + [0] * 241
    m = fit(texts, y)
    assert b"vileword" in m.toxic and b"nastyone" in m.toxic
    pair = _pair(m.ordinary, m.toxic)
    for t in (text(["vileword"]), text([]), "", "vileword " * 30):
        words = t.lower().split()
        runs = [" ".join(words[i : i + 8]).encode() for i in range(0, len(words), 8)] or [b""]
        g = [len(pair[0].compress(w)) - len(pair[1].compress(w)) for w in runs]
        f = [sum(g) / len(g), sum(x >= 2 for x in g) / len(g), sum(x >= 3 for x in g) / len(g)]
        z = sum(w * (x - a) / s for w, x, a, s in zip(m.weights, f, m.mean, m.spread)) + m.weights[-1]
        assert math.isclose(score(t, m, pair), 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    new = [score(text(["vileword"] * k), m, pair) for k in (0, 0, 0, 2, 2, 2)]
    assert max(new[:3]) < min(new[3:])


def test_leaning_strings_against_counts():
    toxic, ordinary = [b"xx badbad yy %d" % i for i in range(40)], [b"xx good yy %d" % i for i in range(200)] + [b"badbad"]
    strings = np.unique(np.concatenate([_strings(t) for t in toxic]))
    n, other = document_counts(toxic + ordinary, strings, np.array([0] * 40 + [1] * 201), 2)
    got = {int(x).to_bytes(PIECE, "big") for x in strings[leaning(n, 40, other, 201)]}
    every = {t[i : i + PIECE] for t in toxic for i in range(len(t) - PIECE + 1)}
    def leans(x):
        n, o = (sum(x in t for t in side) for side in (toxic, ordinary))
        ratio = math.log((n + 0.5) / 41) - math.log((o + 0.5) / 202)
        return ratio > math.log(RATIO) and ratio > SURE * math.sqrt(1 / (n + 0.5) + 1 / (o + 0.5))
    assert got == {x for x in every if leans(x)} and b"badbad" in got and b"xx bad" in got


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_runs_agree(spark, sf):
    a, b = (sorted(map(tuple, op7_toxicity(spark, f"/root/testdata/{sf}").collect())) for _ in range(2))
    assert a == b and len(a) == 200
