"""Spans against the regular-expression module, kind by kind."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from tracewell.llm.automaton import compile_rules, parse
from tracewell.llm.secret_scan import BASE_RULES, MORE_RULES, op4_secret_scan, redact_secrets, scan_secrets, spans_of_text

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def expected(text):
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


pieces = st.sampled_from(
    ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", '"', "'", "==", "a", "é", "AKIA", "ABC123", "0123456789ab", "\n", "x", "_", "日本", "IAK", "A"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=25))
def test_matches_brute_force(parts):
    text = "".join(parts)
    assert spans_of_text(text, BASE_RULES) == expected(text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab-c", max_size=12))
def test_automaton_accepts_what_the_expression_does(text):
    rule = "(ab|a-)*c?[^b]{1,2}"
    dfa = compile_rules([parse(rule)], anywhere=False)
    s = dfa.start
    for b in text.encode():
        s = dfa.moves[s + b]
    assert (s >= dfa.accepting) == bool(re.fullmatch(rule, text))


def test_minimal_automaton_is_small():
    assert compile_rules([parse("(a|b)*abb")], anywhere=False).states == 5  # four and the dead one


def test_more_rules_find_their_kinds():
    text = "x ghp_" + "a1" * 20 + " y -----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA\n"
    kinds = {(*BASE_RULES, *MORE_RULES)[r].kind for _, _, r in spans_of_text(text, (*BASE_RULES, *MORE_RULES))}
    assert {"code_host", "private_key"} <= kinds


def test_rows_nulls_and_repeats(spark):
    df = spark.createDataFrame(
        [(1, "token = abcdef", "z"), (1, "token = abcdef", "z"), (None, None, None), (2, "", "q")], "doc_id long, text string, spans string"
    )
    rows = scan_secrets(df).collect()
    assert len(rows) == 4
    assert sorted(r["n_assign"] for r in rows) == [0, 0, 1, 1]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in rows if r["doc_id"] != 1} == {empty}
    assert redact_secrets(df).filter("doc_id = 1").first()["text"] == "[SECRET]"
    assert scan_secrets(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    d = f"/root/testdata/{sf}"
    got = {r["doc_id"]: r for r in op4_secret_scan(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        want = ",".join(f"{BASE_RULES[k].kind}:{s}:{e}" for s, e, k in expected(r["text"] or ""))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
