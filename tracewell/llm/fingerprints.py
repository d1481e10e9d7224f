"""Document fingerprints as Merkle trees over sections, paragraphs and pieces.

A paragraph is a line with its line feed. It is cut into pieces of about 20 bytes
where a hash of the last eight bytes says so, and after ``MOST`` bytes at the latest, as text
that repeats itself may never say so. Paragraphs are joined into sections
of about four where the hash of a paragraph says so. All this depends on content alone, so
an edit changes the nodes around it and leaves the others as they were; within a stretch cut
by length only, the pieces before it.

The tree has its nodes written out: the fingerprint is ``root:length``, then ``/node`` for each
section, and in it ``.node`` for each paragraph, followed by its pieces. A piece is six
characters: 30 bits of hash and its length. A paragraph's node is of a SHA-256 over its pieces'
full hashes, a section's over its paragraphs' nodes, and the root the first half of one over
the sections' nodes. Equal roots mean equal texts. Where roots differ, nodes are compared from
the top, and only what hangs below differing ones is looked at, down to the pieces that
locate the edits. So a fingerprint is about two fifths as long as its text: what locates edits to
twenty bytes has to name every twenty bytes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words

WINDOW, PIECE, MOST, SECTION = 8, 20, 60, 4
RANGE_BYTES, MOST_RANGES, SAMPLES = 32 << 20, 20_000, 5
_DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
_VALUE = {chr(c): i for i, c in enumerate(_DIGITS)}


def fingerprints(column: pa.Array) -> Iterator[str]:
    """The fingerprint of each text, nulls as empty."""
    for i, j, data, offsets in words.chunks(column):
        n = len(data)
        if not n:
            yield from [_join(b"", [], b"", 0)] * (j - i)
            continue
        line_feed = data == 10
        ends = line_feed.copy()
        filled = offsets[1:][np.diff(offsets) > 0]
        ends[filled - 1] = True  # of paragraphs
        cuts = ends.copy()
        if n >= WINDOW:
            at = np.arange(WINDOW, n + 1)
            begun = np.repeat(offsets[:-1], np.diff(offsets))[at - 1]
            h = words.span_hashes(data, at - WINDOW, at)
            cuts[WINDOW - 1 :] |= (h % np.uint64(PIECE) == 0) & (at - WINDOW >= begun)
        e = np.flatnonzero(cuts) + 1
        s = np.concatenate([[0], e[:-1]])
        more = (e - s - 1) // MOST  # cuts by length
        nth = np.arange(more.sum() + len(e)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        s, e = np.repeat(s, more + 1) + nth * MOST, np.repeat(e, more + 1)
        e = np.minimum(s + MOST, e)
        h = words.span_hashes(data, s, e)
        pe = np.flatnonzero(ends) + 1
        ps = np.concatenate([[0], pe[:-1]])
        section_end = words.span_hashes(data, ps, pe) % np.uint64(SECTION) == 0
        section_end[np.searchsorted(pe, filled)] = True
        mark = np.zeros(n + 1, np.uint8)
        mark[pe] = np.where(section_end, ord("/"), ord("."))
        code = (h >> np.uint64(34) << np.uint64(6)) | (e - s).astype(np.uint64)
        out = np.empty((len(e), 7), np.uint8)
        for k in range(6):
            out[:, k] = _DIGITS[(code >> np.uint64(30 - 6 * k)) & np.uint64(63)]
        out[:, 6] = mark[e]
        used = out != 0
        body = out[used].tobytes()
        size = np.concatenate([[0], np.cumsum(used.sum(1))])
        first = np.searchsorted(e, offsets, "right")
        raw = h.tobytes()
        inner = np.flatnonzero(out[:, 6])
        inner_first = np.searchsorted(inner, first)
        after, last = ((inner + 1) * 8).tolist(), (out[inner, 6] == ord("/")).tolist()
        for k in range(len(first) - 1):
            a, b = first[k], first[k + 1]
            p, q = inner_first[k], inner_first[k + 1]
            bounds = zip([8 * int(a), *after[p : q - 1]], after[p:q], last[p:q])
            length = offsets[k + 1] - offsets[k]
            yield _join(raw, list(bounds), body[size[a] : size[b]], length)


def _join(raw: bytes, paragraphs: list[tuple[int, int, bool]], body: bytes, length: int) -> str:
    """The fingerprint, from the bounds of each paragraph's hashes in ``raw`` and whether a section ends there."""
    top, section, text, own = [], [], [], []
    for (a, b, ends), pieces in zip(paragraphs, re.split(r"[./]", body.decode())):
        section.append(hashlib.sha256(b"p" + raw[a:b]).digest())
        own.append(f".{_short(section[-1])}{pieces}")
        if ends:
            top.append(hashlib.sha256(b"s" + b"".join(section)).digest())
            text += ["/", _short(top[-1]), *own]
            section, own = [], []
    return f"{hashlib.sha256(b'r' + b''.join(top)).hexdigest()[:32]}:{length}{''.join(text)}"


def _short(digest: bytes) -> str:
    """A node as eight characters."""
    return base64.b64encode(digest[:6], b"-_").decode()


def _children(nodes: list[str], mark: str) -> list[str]:
    """The nodes below some others, each with all that hangs below it."""
    return [x for n in nodes for x in n.split(mark)[1:]]


def _pieces(paragraphs: list[str]) -> list[str]:
    return [x[k : k + 6] for x in paragraphs for k in range(8, len(x), 6)]


def _differing(a: list[str], b: list[str], size: int) -> tuple[list[str], list[str]]:
    """What is left of each side when equal nodes, named by their first characters, are set against each other."""
    x, y = Counter(n[:size] for n in a), Counter(n[:size] for n in b)
    both = x & y
    if not both:
        return a, b
    out = []
    for side, of in ((a, x), (b, y)):
        left, rest = dict(both), []
        for n in side:
            if left.get(n[:size]):
                left[n[:size]] -= 1
            else:
                rest.append(n)
        out.append(rest)
    return out[0], out[1]


def _length(fingerprint: str) -> int:
    return int(fingerprint[33:].split("/", 1)[0])


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the part of both texts, by length, that lies in equal nodes."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = _differing(_children([a], "/"), _children([b], "/"), 8)  # sections
    left, right = _differing(_children(left, "."), _children(right, "."), 8)  # paragraphs
    left, right = _differing(_pieces(left), _pieces(right), 6)
    return 1.0 - sum(_VALUE[x[5]] for x in (*left, *right)) / (_length(a) + _length(b))


def _between(a: list[str], b: list[str], size: int) -> tuple[int, int]:
    """How many nodes are equal at both beginnings, and at both ends."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start][:size] == b[start][:size]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end][:size] == b[-1 - end][:size]:
        end += 1
    return start, end


def edited_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Byte spans of the text of ``a`` that lie in pieces which ``b`` doesn't have in their place.

    From the root down: of sections, then of paragraphs, then of pieces, equal ones at both ends are left
    out, and what stands between goes on; there, pieces of ``b`` that lie elsewhere between count too.
    """
    if a[:32] == b[:32]:
        return []
    size = lambda pieces: sum(_VALUE[p[5]] for p in pieces)
    x, y = _children([a], "/"), _children([b], "/")  # sections
    start, end = _between(x, y, 8)
    at = size(_pieces(_children(x[:start], ".")))
    x, y = (_children(n[start : len(n) - end], ".") for n in (x, y))  # paragraphs
    start, end = _between(x, y, 8)
    at += size(_pieces(x[:start]))
    x, y = (_pieces(n[start : len(n) - end]) for n in (x, y))
    start, end = _between(x, y, 6)
    at += size(x[:start])
    have, out = Counter(y[start : len(y) - end]), []
    for p in x[start : len(x) - end]:
        if have[p]:
            have[p] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + _VALUE[p[5]])
        else:
            out.append((at, at + _VALUE[p[5]]))
        at += _VALUE[p[5]]
    return out


def edited_text(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _columns(ids: pa.Array, texts: list[str], nexts: list[str]) -> list[pa.Array]:
    edited = [edited_text(a, b) for a, b in zip(texts, nexts)]
    own, new, following = (list(fingerprints(pa.array(x, pa.string()))) for x in (texts, edited, nexts))
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(own, pa.string()),
        pa.array(new, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
    ]


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = ", n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _along(batches):
    """Each row of a sorted partition against the next; the row that comes last is the next one's and nothing else."""
    last_id = last = None
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            ids, texts = b.column(0), [x or "" for x in b.column(1).to_pylist()]
            if last is not None:
                ids, texts = pa.concat_arrays([last_id, ids]), [last, *texts]
            last_id, last = ids.slice(len(ids) - 1), texts[-1]
            if len(texts) > 1:
                yield pa.RecordBatch.from_arrays(_columns(ids.slice(0, len(ids) - 1), texts[:-1], texts[1:]), _NAMES)


def _key(row) -> tuple:
    """A row's place in the order of ids, nulls first, then of the texts' hashes."""
    return row["id"] is not None, row["id"], row["h"]


def _ranges(src: DataFrame, seed: int = 9) -> list[tuple]:
    """The first key of each range: rows of the table, about ``RANGE_BYTES`` of text apart, from a sample of keys.

    At most ``MOST_RANGES``. The sample that reaches the driver has about ``SAMPLES`` keys a range, so 100,000 or few more, each an id
    and a hash.
    """
    whole = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(F.struct(F.col("id").isNotNull(), "id", "h")).alias("first")).first()
    if not whole["n"]:
        return []
    least = 2 * src.sparkSession.sparkContext.defaultParallelism
    parts = min(MOST_RANGES, max(least, -(-(whole["bytes"] or 0) // RANGE_BYTES)))
    some = src.select("id", "h").sample(min(1.0, SAMPLES * parts / whole["n"]), seed).collect()
    first = (whole["first"][0], whole["first"]["id"], whole["first"]["h"])
    keys = sorted({_key(r) for r in some} - {first})
    step = max(1, len(keys) / parts)
    return [first] + [keys[int(i * step)] for i in range(1, parts) if int(i * step) < len(keys)]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Documents are compared with their edited text and with the next one by ascending id, after the
    last the first. Rows with equal ids are ordered by a hash of their text, null ids come first,
    null texts are empty; a table of one row has that row as its own next, and an empty one gives
    no rows. Rows that repeat are each other's next. Other columns are not looked at.

    Texts are dealt by ranges of keys, in one shuffle. Ranges begin with rows that are known before, so
    each range is sent the first text of the next as well, and compares all its rows by itself.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    begins = _ranges(src)
    parts = max(1, len(begins))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), hashes.to_pylist())
        return pa.array([bisect.bisect_right(begins, (i is not None, i, h)) - 1 for i, h in rows], pa.int32())

    keys = [(i, h, (n - 1) % parts) for n, (_, i, h) in enumerate(begins)]
    first = docs.sparkSession.createDataFrame(keys, f"first_id {id_type}, first_h long, part int")  # MOST_RANGES rows at most
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    nexts = src.join(F.broadcast(first), same).groupBy("part", "id", "h").agg(F.min("text").alias("text"))
    rows = src.withColumn("part", range_of("id", "h")).withColumn("next", F.lit(0))
    rows = rows.unionByName(nexts.withColumn("next", F.lit(1)))
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", "next", "id", "h", "text")
    out = dealt.select("id", "text").mapInArrow(_along, f"id {id_type}{_TYPES}")
    return out.withColumnRenamed("id", id_col)


def op9_document_fingerprints(spark, sf_dir):
    """The fingerprints of every document and of its edited text."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
