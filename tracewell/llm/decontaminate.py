"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

A random walk reads a word sequence: at each step it writes the word under its pointer,
and a random function of step and word says whether the pointer moves on. Two sequences
that share the walk and differ by few edits soon fall into step again, so a small edit
distance becomes a small Hamming distance. Bit sampling hashes a few coordinates of the
written sequence; windows with equal hashes are candidates, and several walks with
several samples each reach the recall wanted. Candidates are confirmed by their edit distance.

Every word of a document opens a window of each item size (sizes are classed by factors
of 1.5, and an item longer than ``LONGEST`` words is several items: if it has a tenth of edits,
so has one of its parts). The walks of all windows of a batch go on together, step by step,
and a shorter window's walk is the beginning of a longer one's, so all classes share them.
Walks that meet stay together and keep their order. From then on they are one
walker for a run of windows, so a batch has fewer walkers with each step, and samples are
hashed once for each walker that is left at the first step that they look at.

Windows that lie over each other share a region of ``REGION`` words at most (more only where one hash is that of a longer
run of windows), whose words travel once for each item that has a hash there. So a document that holds a whole benchmark
costs what its items cost, each beside a few of its neighbours. What regions that overlap find twice is told apart at the end. The hashes of the
items reach the documents as three bitmaps, sized by the number of hashes up to ``MOST_HASHES``; a
larger benchmark is searched in so many rounds. Hashes found in a bitmap are joined with the items'
hashes in full.

Items of fewer than ``LEAST_WORDS`` words are searched as they are, by a hash of all their words.

Measured on random passages (see the tests): all exact copies are found, and over 0.95 of those of 15 to
200 words with one word in ten edited.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words
from tracewell.llm.rows import keep_rows, row_hash
from tracewell.scratch import cut, drop

WALKS, SAMPLES, COORDINATES = 3, 12, 4
LEAST_WORDS, LONGEST = 5, 48
EDITS = 0.1
REGION = 160
COARSE_POWER = 16
BITS_A_HASH = 6  # as a power of two, in each bitmap
MOST_HASHES = 1 << 21
CLASSES = (5, 7, 10, 15, 22, 33)
#: The step from which on a class has its coordinates: walks have met by then.
BASE = (1, 2, 4, 6, 6, 6)
#: Steps whose word can be a coordinate, further apart in the end, and those after which walkers that have met are joined.
TIMES = (*range(1, 19), *range(20, 29, 2), *range(31, 56, 3))
JOIN = (1, 2, 4, 6, 9, 13, 18, 26, 37)
_RNG = np.random.Generator(np.random.PCG64(4242))
_COIN = _RNG.integers(1, 2**63, WALKS, dtype=np.uint64) | np.uint64(1)
_FACTOR = _RNG.integers(1, 2**63, (WALKS, len(TIMES)), dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 2**63, 2 * LEAST_WORDS, dtype=np.uint64) | np.uint64(1)


def _coordinates(c: int, base: int) -> np.ndarray:
    """Numbers of the ``TIMES`` of a class's samples, spread evenly over the steps of its windows."""
    at = np.array([t for t in TIMES if base <= t <= 1.7 * c])
    p = np.diff(np.append(base - 1, at)) / (at[-1] - base + 1)
    some = [[np.sort(_RNG.choice(at, COORDINATES, replace=False, p=p)) for _ in range(SAMPLES)] for _ in range(WALKS)]
    return np.searchsorted(TIMES, some)


_AT = [_coordinates(*x) for x in zip(CLASSES, BASE)]


def size_class(n: int) -> int:
    """The class of an item of ``n`` words: a number in ``CLASSES``, below 0 if it is short (then ``-n``)."""
    return max(i for i, c in enumerate(CLASSES) if c <= n) if n >= LEAST_WORDS else -n


def _longest(c: int) -> int:
    """The most words of an item of a class."""
    return -c if c < 0 else CLASSES[c + 1] - 1 if c + 1 < len(CLASSES) else LONGEST


def _sequence(column: pa.Array):
    """Word hashes of runs of rows, a 0 after each row, and each row's first word."""
    for i, j, data, offsets in words.chunks(column, 1 << 20):
        lower = words.LOWER[data]
        s, e, first = words.word_spans(lower, offsets)
        h = words.span_hashes(lower, s, e) | np.uint64(1)
        out = np.zeros(len(h) + j - i, np.uint64)
        row = np.repeat(np.arange(j - i), np.diff(first))
        out[np.arange(len(h)) + row] = h
        yield i, j, out, first + np.arange(j - i + 1)


def _walkers(seq: np.ndarray, start: np.ndarray, walk: int, last: int):
    """For each of the first ``last`` ``TIMES``: the words under the walkers, and, where walkers have been joined, where they have gone and the first of each one's starts.

    A walker never moves from the 0 after a row.
    """
    coin = seq * _COIN[walk]  # a bit for each step, and still the word's name
    at, out = start.astype(np.int64), []
    word = coin.take(at)
    first = np.arange(len(start))
    for t in range(1, TIMES[last - 1] + 1):
        at += (word >> np.uint64(t + 8) & np.uint64(1)).view(np.int64)
        gone = None
        if t in JOIN:
            new = np.ones(len(at), bool)
            np.not_equal(at[1:], at[:-1], out=new[1:])
            kept = np.flatnonzero(new)
            at, first, gone = at.take(kept), first.take(kept), np.cumsum(new) - 1
        word = coin.take(at)
        if t in JOIN or t == TIMES[len(out)]:
            out.append((word, gone, first))
    return out


def signatures(seq: np.ndarray, start: np.ndarray, classes: list[int]):
    """``(class, hashes, first)`` of each sample for the windows of ``seq`` that open at ``start``, ascending.

    A hash belongs to the windows from ``start[first]`` on, up to the next one's.
    """
    for c in (c for c in classes if c < 0):
        fits = np.flatnonzero(start < len(seq) + c)
        h = np.full(len(fits), _SHORT[c], np.uint64)
        for i in range(-c):
            h += seq.take(start[fits] + i) * _SHORT[i]
        yield c, h, fits
    long = [c for c in classes if c >= 0]
    for walk in range(WALKS if long else 0):
        met = _walkers(seq, start, walk, 1 + max(int(_AT[c][walk].max()) for c in long))
        for base in sorted({BASE[c] for c in long}):
            mine = [c for c in long if BASE[c] == base]
            need = {int(t) for c in mine for t in _AT[c][walk].ravel()}
            part, now, b = {}, None, TIMES.index(base)
            for t in range(b, max(need) + 1):
                word, gone, _ = met[t]
                if t > b and gone is not None:
                    now = gone if now is None else gone.take(now)
                if t in need:
                    word = word * _FACTOR[walk, t]
                    part[t] = word if now is None else word.take(now)
            for c in mine:
                for x, y, *more in _AT[c][walk].tolist():
                    h = part[x] + part[y]
                    for t in more:
                        h += part[t]
                    yield c, h, met[b][2]


def _places(h: np.ndarray, power: int) -> list[np.ndarray]:
    """The places of a hash in the three bitmaps."""
    s, low = np.uint64(64 - 2 * power), np.uint64((1 << power) - 1)
    return [x.astype(np.int64) for x in (h >> np.uint64(64 - power), (h >> s) & low, (h ^ (h >> np.uint64(power))) & low)]


def in_bitmaps(h: np.ndarray, bitmaps: list[np.ndarray], power: int) -> np.ndarray:
    """Whether each hash is in all three bitmaps."""
    hit = np.ones(len(h), bool)
    for m, p in zip(bitmaps, _places(h, power)):
        hit &= (m.take(p >> 3) >> (p & 7).astype(np.uint8)) & np.uint8(1) > 0
    return hit


def bitmaps_of(hashes: DataFrame, power: int) -> list[bytes]:
    """Three bitmaps of the column ``hash``, of ``2 ** power`` bits each."""
    h, low = F.col("hash"), F.lit((1 << power) - 1)
    places = [
        F.shiftrightunsigned(h, 64 - power),
        F.shiftrightunsigned(h, 64 - 2 * power).bitwiseAND(low),
        h.bitwiseXOR(F.shiftrightunsigned(h, power)).bitwiseAND(low),
    ]
    each = hashes.select(F.posexplode(F.array(*[p + 1 for p in places])).alias("which", "place"))
    maps = each.groupBy("which", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    per = 32768 // 8
    out = [bytearray(max(per, (1 << power) // 8)) for _ in places]
    for r in maps.collect():  # bucket 1 holds the first 32768 places
        out[r["which"]][(r["bucket"] - 1) * per : r["bucket"] * per] = bytes(r["bits"])
    return [bytes(x) for x in out]


def _items(id_type: str):
    """Each item, or part of a long one, with its words and all its hashes."""

    def run(batches):
        for b in batches:
            ids, part, body = [], [], []
            for i, j, seq, first in _sequence(b.column(1)):
                for r in range(j - i):
                    w = seq[first[r] : first[r + 1] - 1]
                    cuts = np.linspace(0, len(w), max(1, -(-len(w) // LONGEST)) + 1).astype(int)
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if y > x:
                            ids.append(b.column(0)[i + r])
                            part.append(p)
                            body.append(w[x:y])
            kind = np.array([size_class(len(w)) for w in body], np.int64)
            hashes = [[] for _ in body]
            if body:
                seq = np.concatenate([x for w in body for x in (w, np.zeros(1, np.uint64))])
                size = np.array([len(w) + 1 for w in body])
                start = np.cumsum(size) - size
                for c, h, first in signatures(seq, start, sorted(set(kind.tolist()))):
                    windows = np.searchsorted(first, np.arange(len(start)), "right") - 1
                    for k in np.flatnonzero(kind == c):
                        hashes[k].append(h[windows[k]].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(0).type), pa.array(part, pa.int32()), pa.array(kind, pa.int32()),
                 pa.array([w.astype(np.int64) for w in body], pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))],
                ["item", "part", "class", "body", "hashes"],
            )

    return run, f"item {id_type}, part int, class int, body array<long>, hashes array<long>"


def _probe(bitmaps: list[bytes], power: int, classes: list[int], id_type: str):
    """Regions of windows whose hash is in all bitmaps, with their words."""

    def run(batches):
        bits = [np.frombuffer(m, np.uint8) for m in bitmaps]
        whole = np.unpackbits(bits[0][: max(1, (1 << power) // 8)], bitorder="little")[: 1 << power].view(bool)
        coarse_power = min(COARSE_POWER, power)
        coarse = whole.reshape(1 << coarse_power, -1).any(1)  # small enough for the cache
        del whole
        for b in batches:
            rows = []
            for i, j, seq, first in _sequence(b.column(2)):
                rows += [(b.column(0)[i + r], b.column(1)[i + r], *x) for r, *x in regions(seq, first, bits, coarse, coarse_power)]
                if len(rows) > 2000:
                    yield _out(rows, b)
                    rows = []
            yield _out(rows, b)

    def regions(seq, first, bits, coarse, coarse_power):
        start, found = np.flatnonzero(seq), []
        for c, h, lead in signatures(seq, start, classes):
            maybe = np.flatnonzero(coarse.take((h >> np.uint64(64 - coarse_power)).view(np.int64)))
            if not len(maybe):
                continue
            some = h[maybe]
            k = maybe[in_bitmaps(some, bits, power)]
            if len(k):
                ends = np.append(lead[1:], len(start)) if c >= 0 else lead + 1
                extra = int(_longest(c) * EDITS) + 1
                found.append((start[lead[k]], extra, start[ends[k] - 1] + _longest(c) + extra, h[k]))
        if not found:
            return
        opens, high, h = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3))
        low = opens - np.repeat([x[1] for x in found], [len(x[0]) for x in found])
        row = np.searchsorted(first, opens, "right") - 1
        low, high = np.maximum(low, first[row]), np.minimum(high, first[row + 1] - 1)
        order = np.argsort(low, kind="stable")
        h, low, high, row = h[order].astype(np.int64), low[order].tolist(), high[order].tolist(), row[order].tolist()
        x = 0
        while x < len(low):
            r, top, y = row[x], high[x], x + 1
            most = max(top, low[x] + REGION)
            while y < len(low) and row[y] == r and low[y] <= top and high[y] <= most:
                top = max(top, high[y])
                y += 1
            yield r, int(low[x] - first[r]), seq[low[x] : top].astype(np.int64), np.unique(h[x:y])
            x = y

    def _out(rows, b):
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [b.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["id", "row", "begin", "words", "hashes"])

    return run, f"id {id_type}, row long, begin long, words array<long>, hashes array<long>"


def _distances(item: list, text: list, anchored: bool) -> list[int]:
    """Edits from ``item`` to the best part of ``text`` that ends after each word, or, anchored, to all of it up to there.

    The differences of a column of the edit matrix are the bits of two numbers.
    """
    m = len(item)
    all_, top = (1 << m) - 1, 1 << m - 1
    of: dict = {}
    for i, w in enumerate(item):
        of[w] = of.get(w, 0) | 1 << i
    up, down, score, out = all_, 0, m, []
    for w in text:
        same = of.get(w, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same
        more, less = down | ~(d | up) & all_, up & d
        score += 1 if more & top else -1 if less & top else 0
        out.append(score)
        more = (more << 1 | anchored) & all_
        up, down = less << 1 & all_ | ~(x | more) & all_, more & x
    return out


def best_match(item: list, text: list) -> tuple[int, int, int]:
    """``(distance, start, end)`` of the part of ``text`` that takes the fewest edits to ``item``: the first such end, and the last start for it."""
    to = _distances(item, text, False)
    end = min(range(len(to)), key=to.__getitem__) + 1 if to else 0
    if not to or to[end - 1] >= len(item):
        return len(item), 0, 0
    back = _distances(item[::-1], text[:end][::-1], True)
    return to[end - 1], end - 1 - back.index(to[end - 1]), end


def matches(item: list, text: list, most: float) -> list[tuple[int, int, int]]:
    """:func:`best_match`, and again before and after it, as long as ``most`` edits suffice."""
    out, open_ = [], [(0, len(text))]
    while open_:
        a, b = open_.pop()
        if b - a < len(item) - most:
            continue
        near = text[a:b]
        if len(item) - sum((Counter(item) & Counter(near)).values()) > most:
            continue  # a word that isn't near at all is an edit at least
        d, s, e = best_match(item, near)
        if d <= most:
            out.append((d, a + s, a + e))
            open_ += [(a, a + s), (a + e, b)]
    return out


def _verify(batches):
    for b in batches:
        of, distance, start, end = [], [], [], []
        begin = b.column("begin").to_pylist()
        for k in range(b.num_rows):
            item, near = (b.column(n)[k].values.to_pylist() for n in ("body", "words"))
            for d, s, e in matches(item, near, EDITS * len(item)):
                of.append(k)
                distance.append(d)
                start.append(begin[k] + s)
                end.append(begin[k] + e)
        t = b.take(pa.array(of, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [t.column("id"), t.column("row"), t.column("item"), t.column("part"), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(distance, pa.int64())],
            ["id", "row", "item", "part", "start", "end", "distance"],
        )


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, distance)`` of places that don't overlap: of two that do the closer one, of equal ones the first."""
    out: list[tuple[int, int, int]] = []
    for x in sorted(set(found)):
        if not out or out[-1][1] <= x[0]:
            out.append(x)
        elif x[2] < out[-1][2]:
            out[-1] = x
    return out


def _apart(batches):
    for b in batches:
        places = [apart([(x["start"], x["end"], x["distance"]) for x in xs]) for xs in b.column(4).to_pylist()]
        of = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in places]))
        flat = [x for xs in places for x in xs]
        t = b.take(of)
        yield pa.RecordBatch.from_arrays(
            [*(t.column(i) for i in range(4)), *(pa.array([x[i] for x in flat], pa.int64()) for i in range(3))],
            ["id", "row", "item", "part", "start", "end", "distance"],
        )


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(id, row, item, part, start, end, distance)`` of every passage found.

    ``start`` and ``end`` count words of the document, ``distance`` counts word edits, at most a
    tenth of the item's words (or of its ``part``, if it is cut); words compare in lower case (A-Z). One row
    an item and place; places of one item don't overlap, and of equal ones the first counts.

    Null and empty texts and items match nothing, null ids of either are values like others. Rows that repeat
    (the same id and text) are reported once, an item that repeats under other ids for each. Texts and items
    may have any length. An empty table on either side gives no rows; other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    run, schema = _items(item_type)
    items = cut(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).mapInArrow(run, schema), "dc-items")
    hashed = items.select("item", "part", F.explode("hashes").alias("hash"))
    kinds = items.groupBy("class").agg(F.sum(F.size("hashes")).alias("n")).collect()  # a row a class
    classes, n = sorted(r["class"] for r in kinds), sum(r["n"] for r in kinds)
    src = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    rounds = max(1, -(-n // MOST_HASHES))
    power = max(COARSE_POWER, (n // rounds).bit_length() + BITS_A_HASH)
    out_schema = f"id {id_type}, row long, item {item_type}, part int, start long, end long, distance long"
    found = None
    for i in range(rounds):
        mine = hashed.filter(F.pmod("hash", F.lit(rounds)) == i)
        probe, probe_schema = _probe(bitmaps_of(mine, power), power, classes, id_type)
        regions = cut(src.mapInArrow(probe, probe_schema), "dc-regions")
        hits = regions.select("id", "row", "begin", F.explode("hashes").alias("hash")).join(mine, "hash")
        hits = hits.select(F.col("id").alias("of"), F.col("row").alias("r"), F.col("begin").alias("at"), "item", "part").distinct()
        here = F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("r")) & (F.col("begin") == F.col("at"))
        pairs = regions.select("id", "row", "begin", "words").join(hits, here).select("id", "row", "begin", "words", "item", "part")
        body = items.select(F.col("item").alias("named"), F.col("part").alias("p"), "body")
        pairs = pairs.join(body, F.col("item").eqNullSafe(F.col("named")) & (F.col("part") == F.col("p")))
        checked = cut(pairs.select("id", "row", "item", "part", "begin", "body", "words").mapInArrow(_verify, out_schema), "dc-found")
        drop(regions)
        found = checked if found is None else found.unionByName(checked)
    drop(items)
    each = found.groupBy("id", "row", "item", "part").agg(F.collect_set(F.struct("start", "end", "distance")).alias("places"))
    return each.mapInArrow(_apart, out_schema)


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark passage.

    Null and empty texts have none and stay, as does a null id without one. Rows that repeat go or stay
    together. Columns stay as they are, whatever their names; an empty table gives no rows, and an empty
    benchmark takes none.
    """
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("doc_id"), "row")
    return keep_rows(docs, cut(found.distinct(), "dc-bad"), "left_anti")


def op1_decontamination(spark, sf_dir):
    """The benchmark passages in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "part", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "distance")
