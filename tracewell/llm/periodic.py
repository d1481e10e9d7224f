"""Runs of repeated words in documents, by a suffix automaton with link-cut access.

The states of a text's suffix automaton, under their suffix links, are a tree in which the path of a prefix to the root holds
all suffixes of that prefix. Words are appended one by one: each append accesses its prefix's path and recolours it with the new end. What had
one colour before is a segment: suffixes that occurred last where that colour says. If the new end lies ``p`` words after it and
the segment's longest suffix has ``p`` words or more, both occurrences overlap or touch: a square of period ``p``, and with the words in between a
stretch of that period that can't be extended to the left. It is a run where the next word breaks it. As the last occurrence is the nearest,
no stretch has a smaller period, and each run is reported once, at its end.

The tree is built first and doesn't change, so its paths are cut and linked along fixed heavy paths: an
access recolours a top part of each of a few of them, which is a stack of colours; all accesses together take
O(n log n) such steps.

An automaton is only built over words that can lie in a run. In one of period ``q``, all short word sequences but the first ``q``
occur again after ``q`` words at most, so stretches of positions whose sequence has come as shortly before as their number
asks for hold all runs; that is found for whole batches by sorting hashes, and equal hashes of different words only add to it. All else
is exact.

One pass over the texts, no shuffle. A task holds one document, and about half a kilobyte for each word of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words
from tracewell.llm.rows import free

LEAST, EXPONENT = 6, 4
ROUNDS = 8
_ROW = np.uint64(0xD1342543DE82EF95)
_FAR = np.iinfo(np.int64).max


class SuffixAutomaton:
    """States of all suffixes of ``seq``: lengths, suffix links, and the state of each prefix."""

    def __init__(self, seq: list):
        step, link, length, ends = [{}], [-1], [0], []
        last = 0
        for n, w in enumerate(seq, 1):
            new = len(step)
            step.append({})
            link.append(0)
            length.append(n)
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = twin
                    while p >= 0 and step[p].get(w) == q:
                        step[p][w] = twin
                        p = link[p]
            ends.append(new)
            last = new
        self.link, self.length, self.ends = link, length, ends


class LastEnds:
    """The tree of suffix links, each state coloured by where its words ended last."""

    def __init__(self, automaton: SuffixAutomaton):
        self.link, self.length = link, length = automaton.link, automaton.length
        down = np.argsort(np.array(length), kind="stable").tolist()  # links lead to shorter states
        size, heavy = [1] * len(link), [-1] * len(link)
        for v in reversed(down[1:]):
            size[link[v]] += size[v]
        for v in down[1:]:
            u = link[v]
            if heavy[u] < 0 or size[v] > size[heavy[u]]:
                heavy[u] = v
        self.head = head = list(range(len(link)))
        for v in down[1:]:
            if heavy[link[v]] == v:
                head[v] = head[link[v]]
        self.colours: list[list] = [[] for _ in link]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colour the path to the root with ``end``; ``(length, end before)`` of the segments that it had, the longest suffix of each."""
        out, link, length = [], self.link, self.length
        while state > 0:
            head, n = self.head[state], length[state]
            stack, done = self.colours[head], 0  # the part next to the root is the last
            while stack and stack[-1][0] <= n:
                out.append(stack.pop())
                done = out[-1][0]
            if stack and done < n:
                out.append((n, stack[-1][1]))
            stack.append((n, end))
            state = link[head]
        return out


def runs_of(seq: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``seq`` of at least ``least`` words and ``exponent`` (2 or more) periods."""
    automaton, out = SuffixAutomaton(seq), []
    tree = LastEnds(automaton)
    for i, state in enumerate(automaton.ends):
        for n, before in tree.access(state, i):
            p = i - before
            if n < (exponent - 1) * p or n + p < least:
                continue
            start = i - p - n + 1
            if (start == 0 or seq[start - 1] != seq[start - 1 + p]) and (i + 1 == len(seq) or seq[i + 1] != seq[i + 1 - p]):
                out.append((start, n + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _shingle(least: int, exponent: int) -> int:
    """So many words fit into what a run of any period has after its first period."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, max(2, least + 1)))


def _stretches(h: np.ndarray, first: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """``(row, from, to)``: words of each row that hold all its runs, by the hashes of the words."""
    k = _shingle(least, exponent)
    s, at = words.shingle_hashes(h, first, k)
    n = len(s)
    if n < 2:
        return
    row = np.repeat(np.arange(len(first) - 1), np.diff(at))
    bits = np.uint64(n.bit_length())
    key = words.mix(s + row.astype(np.uint64) * _ROW) >> bits << bits | np.arange(n, dtype=np.uint64)
    key.sort()
    where = (key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    key >>= bits
    same = key[1:] == key[:-1]
    gap = np.full(n, _FAR)
    gap[where[1:][same]] = (where[1:] - where[:-1])[same]
    idx = np.flatnonzero(gap < _FAR)
    for _ in range(ROUNDS):
        if not len(idx):
            return
        new = np.ones(len(idx), bool)
        new[1:] = (idx[1:] != idx[:-1] + 1) | (row[idx[1:]] != row[idx[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(idx)))
        most = (size + k - 1) // (exponent - 1)  # a longer period can't have a run here
        ok = gap[idx] <= np.repeat(most, size)
        if ok.all():
            break
        idx = idx[ok]
    new = np.ones(len(idx), bool)
    new[1:] = (idx[1:] != idx[:-1] + 1) | (row[idx[1:]] != row[idx[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(idx)))
    last = None
    for b, m in zip(idx[begin].tolist(), size.tolist()):
        r = int(row[b])
        x = b - int(at[r])
        lo, hi = max(0, x - (m + k - 1) // (exponent - 1)), x + m + k - 1
        if last and last[0] == r and lo <= last[2]:
            last = (r, min(lo, last[1]), max(hi, last[2]))
        else:
            if last:
                yield last
            last = (r, lo, hi)
    if last:
        yield last


def _runs_in(spelled: list[bytes], parts: list[tuple[int, int]], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs of a document, all of which lie inside ``parts``."""
    out = set()
    for lo, hi in parts:
        for start, n, p in runs_of(spelled[lo:hi], least, exponent):
            start, end = start + lo, start + lo + n
            if (start == 0 or spelled[start - 1] != spelled[start - 1 + p]) and (end >= len(spelled) or spelled[end] != spelled[end - p]):
                out.add((start, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(spelled: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    drop = bytearray(len(spelled))
    for start, n, p in runs:
        drop[start + p : start + n] = b"\1" * (n - p)
    return [w for w, d in zip(spelled, drop) if not d] if runs else spelled


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of those that tie the first, and then that of the smallest period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(id_type: str, least: int, exponent: int):
    def run(batches):
        for b in batches:
            for i, j, data, offsets in words.chunks(b.column(1)):
                s, e, first = words.word_spans(data, offsets)
                parts: dict[int, list[tuple[int, int]]] = {}
                for r, lo, hi in _stretches(words.span_hashes(data, s, e), first, least, exponent):
                    parts.setdefault(r, []).append((lo, hi))
                raw, found, kept = data.tobytes(), [], []
                for r in range(j - i):
                    spelled = raw[offsets[r] : offsets[r + 1]].split()
                    found.append(_runs_in(spelled, parts[r], least, exponent) if r in parts else [])
                    kept.append(b" ".join(_collapsed(spelled, found[-1])))
                as_runs = pa.array([[dict(zip(("start", "length", "period"), x)) for x in runs] for runs in found], pa.list_(_RUN))
                best = pa.array([None if not x else dict(zip(("start", "length", "period"), best_run(x))) for x in found], _RUN)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), as_runs, best, pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "best", "collapsed"],
                )

    run_type = "struct<start: long, length: long, period: long>"
    return run, f"id {id_type}, n_words long, runs array<{run_type}>, best {run_type}, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``(id, n_words, runs, best, collapsed)`` for every row of ``docs``.

    A run is a stretch of consecutive words with smallest period ``q``, of at least ``least`` words and ``exponent`` (2 or more)
    periods, that no neighbouring word extends. ``runs`` lists ``(start, length, period)`` by start, then period, words counted from 0; ``best`` is the
    one with the most periods (of those that tie the first, then that of the smallest period), or null. ``collapsed`` is the text's words, joined by
    one space, without those that any run contains after its first period.

    Null, empty and blank texts have no words and no runs, and ``collapsed`` is empty. Ids may be null or repeat; rows that
    repeat are found each. Texts may have any length. An empty table gives no rows; other columns are not looked at.
    """
    run, schema = _find(docs.schema[id_col].dataType.simpleString(), least, exponent)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which a tenth of the texts, by a hash of their ids, repeat a stretch of their words to the end.

    Texts without words, and those without an id, stay as they are.
    """
    at, hash_ = free(docs, "_words", "_hash")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    some = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.withColumn(hash_, h).select("*", F.explode(F.array(F.when(F.col(hash_) % 10 == 0, some))).alias(at))  # evaluated once
    g, n = F.floor(F.col(hash_) / 10).cast("long"), F.size(at)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(at, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(at, F.lit(1), a), tail), " ")
    return d.withColumn(text_col, F.when(F.col(at).isNotNull() & (F.size(at) > 0), planted).otherwise(F.col(text_col))).drop(at, hash_)


def op11_periodic_runs(spark, sf_dir):
    """The runs of all documents, a tenth of which have one planted."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    said = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    CAST(doc_id AS VARCHAR) AS s FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(s) + 1), lambda i:
        [ord(s[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS h FROM b),
e AS (SELECT id, doc_id, ws, h, h // 10 AS g, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM c),
d AS MATERIALIZED (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
      THEN list_concat(ws[1:a], list_transform(range(0, n - a), lambda i: ws[a + 1 + i % (1 + (n - a) // (3 + g % 8))])) ELSE ws END AS w FROM e),
f AS MATERIALIZED (SELECT id, i, array_to_string(w[i + 1:i + 5], ' ') AS five FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM d)),
q AS MATERIALIZED (SELECT y.id, y.i, y.i - x.i AS p FROM f x JOIN f y ON x.id = y.id AND x.five = y.five AND x.i < y.i),
o AS (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS island FROM q),
t AS (SELECT id, p, min(i) - p AS s, max(i) + 5 AS e FROM o GROUP BY id, p, island),
u AS MATERIALIZED (SELECT * FROM t WHERE e - s >= greatest(6, 4 * p)),
r AS MATERIALIZED (SELECT id, s AS start, e - s AS length, p AS period FROM u
      WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.id = u.id AND z.p < u.p AND z.s <= u.s AND z.e >= u.e)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length / period DESC, start, period) AS k FROM r) WHERE k = 1),
m AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY id),
x AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
v AS (SELECT id, list(i) AS gone FROM x GROUP BY id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END) AS collapsed_sha256
FROM d LEFT JOIN m USING (id) LEFT JOIN best USING (id) LEFT JOIN v USING (id)
"""
