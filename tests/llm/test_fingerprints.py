"""Fingerprints against the texts they stand for."""

import base64
import hashlib

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tracewell.llm import words
from tracewell.llm.fingerprints import _children, _length, _pieces, edited_spans, edited_text, fingerprint_documents, fingerprints, likeness


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"


def one(text):
    return next(fingerprints(pa.array([text])))


def covered(fingerprint):
    return sum(DIGITS.index(p[5]) for p in _pieces(_children(_children([fingerprint], "/"), ".")))


texts = st.lists(st.sampled_from(["one two ", "three\n", "四五六", "\n", "seven eight nine ten eleven ", "x"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_same_alone_and_among_others(many):
    assert list(fingerprints(pa.array(many))) == [one(t) for t in many]


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_roots_test_equality(a, b):
    x, y = one(a), one(b)
    assert (x == y) == (a == b)
    assert 0 <= likeness(x, y) <= 1 and likeness(x, y) == likeness(y, x)
    assert (likeness(x, y) == 1) or a != b


def test_pieces_cover_the_text():
    text = "The quick brown fox jumps over the lazy dog, and then it sleeps.\nA second line.\n"
    assert covered(one(text)) == _length(one(text)) == len(text)


def test_edits_are_located():
    lines = [f"line number {i} holds some words of its own, {i * i} in all\n" for i in range(60)]
    a, b = "".join(lines), "".join([*lines[:30], "something else altogether, without likeness\n", *lines[31:]])
    x, y = one(a), one(b)
    assert likeness(x, y) > 0.95
    (start, end), = edited_spans(x, y)
    at = len("".join(lines[:30]))
    assert start <= at and at + len(lines[30]) <= end + 1 and end - start < len(lines[30]) + 140
    assert edited_spans(x, x) == [] and edited_spans(x, one("")) == [(0, len(a))] and edited_spans(one(""), x) == []


@settings(max_examples=200, deadline=None)
@given(texts, texts, st.integers(0, 200), st.integers(0, 60))
def test_spans_are_in_order_and_hold_all_edits(a, b, at, n):
    a = a * 4
    new = a[:at] + b + a[at + n :]
    spans = edited_spans(one(a), one(new))
    ends = [0, *(x for span in spans for x in span), len(a.encode())]
    assert ends == sorted(ends) and all(s < e for s, e in spans)
    if n == 0:  # only added to: what was cut anew is in one place
        assert not spans or spans[-1][1] - spans[0][0] <= 8 * 60
    assert (a != new) or not spans


def test_repetition_keeps_what_is_not_edited():
    for word in ["For ", "Der ", "a", "=", "und so ", "ab", "xyz ", "word for word ", "0000", "é"]:
        text = word * (6000 // len(word))
        new = edited_text(text, "quite other words that have nothing in common with it, " * 40)
        x, y = one(text), one(new)
        assert covered(x) == len(text.encode())
        assert likeness(x, y) > 0.7


def test_roots_are_made_of_inner_nodes():
    text = "".join(f"paragraph {i} with some words\n" for i in range(30))
    data, root = text.encode(), one(text)[:32]
    node = lambda kind, parts: hashlib.sha256(kind + b"".join(parts)).digest()
    array, at, sections = np.frombuffer(data, np.uint8), 0, []
    name = lambda digest: base64.b64encode(digest[:6], b"-_").decode()
    for section in _children([one(text)], "/"):
        paragraphs = []
        for p in _children([section], "."):
            raw = []
            for k in range(8, len(p), 6):
                n = DIGITS.index(p[k + 5])
                raw.append(words.span_hashes(array, np.array([at]), np.array([at + n])).tobytes())
                at += n
            paragraphs.append(node(b"p", raw))
            assert p[:8] == name(paragraphs[-1])
        sections.append(node(b"s", paragraphs))
        assert section[:8] == name(sections[-1])
    assert at == len(data) and len(sections) > 1 and node(b"r", sections).hex()[:32] == root


def test_every_row_against_brute_force(spark):
    rows = [(i * 7 % 501, f"text {i} " * (i % 9) + "é" * (i % 5)) for i in range(500)] + [(3, "a"), (3, "b"), (None, None), (900, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fingerprint_documents(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    plain = [r for r in ordered if sum(x[0] == r[0] for x in ordered) == 1]
    nexts = {a[0]: b[1] for a, b in zip(ordered, ordered[1:]) if a in plain and (b in plain)}
    nexts[900] = ""  # the row with a null id comes first
    for i, t in plain:
        if i in nexts:
            e = edited_text(t, nexts[i])
            r = by[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert r["fingerprint"] == one(t) and r["edited_fingerprint"] == one(e)
            assert r["near_edited"] == likeness(one(t), one(e)) and r["near_next"] == likeness(one(t), one(nexts[i]))


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fingerprint_documents(df).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprint_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_no_row_is_lost_or_doubled(spark, reuse):
    """Whatever the planner reuses, and with a third of all rows under one id."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = [(i if i % 3 else 7, f"text {i % 50} of {i}") for i in range(3000)] + [(None, "n"), (None, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = fingerprint_documents(df).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = Counter((i, one(t or "")) for i, t in rows)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == want
