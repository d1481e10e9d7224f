"""Secrets in text, by one automaton for all rules.

All rules are compiled into one minimal automaton (see :mod:`automaton`), and one pass
over the bytes of a text runs it. Where it accepts, a rule has matched up to this byte:
the rule's reversed automaton walks back to the leftmost start, its tail runs on to the
end of the match, and the length is tested. Matches of a kind don't overlap, the
leftmost counts, and one that fails its test still uses up its bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.automaton import compile_rules, parse, reverse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head``, then one or more bytes of the class ``tail``.

    A match counts if its tail (or all of it, with ``whole``) has ``least`` bytes or more.
    """

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = False
    either_case: bool = False


#: The kinds of the contract, then those added. Fixed values.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, either_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 20, whole=True),
    Rule("hex", "", "[0-9a-f]", 24, whole=True),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN[A-Z ]* PRIVATE KEY-----", "[\\x0A\\x0DA-Za-z0-9+/=]", 16),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 8),
    Rule("code_host", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("chat_bot", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("payment", "(sk|rk)_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("map_key", "AIza", "[A-Za-z0-9_-]", 35),
)


@cache
def _compiled(rules: tuple[Rule, ...]):
    """The common automaton; for each rule its backward one, tail bytes, shortest event."""
    trees, back, tails, ends = [], [], [], []
    for r in rules:
        tail = parse(r.tail)
        # a rule without a head would report every byte: wait until the length is reached
        need = r.least if r.whole and not r.head else 1
        tree = ("then", [parse(r.head, r.either_case), ("times", tail, need, need)])
        trees.append(tree)
        back.append(compile_rules([reverse(tree)], anywhere=False))
        tails.append(frozenset(tail[1][0][1]))
        ends.append(compile_rules([parse(r.head, r.either_case)], anywhere=False))
    return compile_rules(trees, anywhere=True), back, tails, ends


def find_spans(data: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """``(start, end, rule)`` in bytes, by start and then by the order of the rules."""
    dfa, back, tails, heads = _compiled(rules)
    moves, accepting, accepts = dfa.moves, dfa.accepting, dfa.accepts
    used = [0] * len(rules)
    out = []
    s = dfa.start
    for i, b in enumerate(data):
        s = moves[s + b]
        if s >= accepting:
            for r in accepts[s]:
                if i < used[r]:
                    continue
                walk, t, start = back[r], back[r].start, -1
                for j in range(i, used[r] - 1, -1):
                    t = walk.moves[t + data[j]]
                    if not t:
                        break
                    if t >= walk.accepting:
                        start = j
                if start < 0:
                    continue
                end, tail, rule = i + 1, tails[r], rules[r]
                while end < len(data) and data[end] in tail:
                    end += 1
                used[r] = end
                begin = start
                if not rule.whole:  # the head is as long as it can be, then comes the tail
                    head, t, j = heads[r], heads[r].start, start
                    while j < end:
                        t = head.moves[t + data[j]]
                        if not t:
                            break
                        j += 1
                        if t >= head.accepting:
                            begin = j
                if end - begin >= rule.least:
                    out.append((start, end, r))
    return sorted(out)


def _digest(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, e, r in sorted(spans, key=lambda x: (x[0], x[2])))


def spans_of_text(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """As :func:`find_spans`, in code points; a null text has none."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = find_spans(data, rules)
    if not found or text.isascii():
        return found
    at = {}
    done = points = 0
    for x in sorted({p for s, e, _ in found for p in (s, e)}):
        points += len(data[done:x].decode("utf-8", "surrogatepass"))
        done = x
        at[x] = points
    return [(at[s], at[e], r) for s, e, r in found]


def _scan(id_type: str, rules: tuple[Rule, ...], base: int):
    kinds = [r.kind for r in rules]

    def run(batches):
        for b in batches:
            counts: list[list[int]] = [[] for _ in kinds]
            every, hashes = [], []
            for text in b.column(1):
                spans = spans_of_text(text.as_py(), rules)
                for r, c in enumerate(counts):
                    c.append(sum(x[2] == r for x in spans))
                first = _digest([x for x in spans if x[2] < base], rules)
                hashes.append(hashlib.sha256(first.encode()).hexdigest())
                every.append(_digest(spans, rules))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(every, pa.string())],
                ["id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"],
            )

    return run, f"id {id_type}, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base_rules: tuple[Rule, ...] = BASE_RULES,
    more_rules: tuple[Rule, ...] = MORE_RULES,
) -> DataFrame:
    """``(id, n_<kind>..., base_sha256, spans)`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` of all rules by start, then in the order of the
    rules; ``base_sha256`` is the hash of that list for the base rules alone. Offsets are
    code points, ends exclusive. Null and empty texts have no spans; ids may be null or
    repeat, rows that repeat have the same spans; the whole of a text is scanned, however long. An empty
    table gives no rows; other columns are not looked at. No shuffle.
    """
    run, schema = _scan(docs.schema[id_col].dataType.simpleString(), (*base_rules, *more_rules), len(base_rules))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def redact_secrets(
    docs: DataFrame, text_col: str = "text", base_rules: tuple[Rule, ...] = BASE_RULES,
    more_rules: tuple[Rule, ...] = MORE_RULES, mask: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``, overlaps as one.

    Nulls stay null and empty texts empty, texts of any length are scanned whole, rows that repeat are redacted alike. Other columns
    stay as they are, whatever their names; an empty table gives no rows.
    """
    rules = (*base_rules, *more_rules)

    @F.udf("string", useArrow=True)
    def run(text):
        if text is None:
            return None
        out, at = [], 0
        for s, e, _ in spans_of_text(text, rules):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join(out) + text[at:]

    return docs.withColumn(text_col, run(text_col))


def op4_secret_scan(spark, sf_dir):
    """The spans of every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
