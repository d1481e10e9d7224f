"""Phrases whose words keep company more often than their parts, counted in HAT-tries.

Each task counts the phrases of its documents in a trie of word ids that is shallow and burstable: below a first word lies
one hash container of all its phrases; a container that grows past ``BURST`` entries bursts into a node with a container
for each next word. Only phrases' word ids are in it, packed into one number each. When all containers together
hold more than ``MOST`` entries, whole subtrees, the largest first, leave the task as runs sorted by words, so a task has the same
memory whatever its input. Runs go to the shuffle rather than to a local disk, and are merged partition by partition.

Words are counted first, then pairs, and so on. A phrase can only be frequent if the phrases of one word less in it are; those reach the tasks as
three bitmaps of hashes, of 16 MB at most each, and what isn't in them is not counted. Where a language is so rich that
bitmaps fill up, more is counted than need be, and nothing is lost.

Partitions are by the whole phrase: by a first word, or any shorter prefix, a common one would be the work of one
task. Counts travel as words, not as hashes, so they are exact. From the frequent phrases on, which are few, all is joins: a part of a
frequent phrase is frequent itself, so scores need nothing that was left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words as W
from tracewell.llm.decontaminate import bitmaps_of, in_bitmaps
from tracewell.operators.ordering import with_running
from tracewell.scratch import cut

BURST, MOST, SLICE, OUT = 4096, 600_000, 1 << 20, 50_000
#: Bits of a bitmap, as powers of two: for each frequent phrase, and at most.
BITS_A_PHRASE, MOST_BITS = 3, 27
_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])


class Node(dict):
    """A container that has burst: the containers and nodes below it, by next word."""


class _Ids(dict):
    """Numbers words from 1, in the order in which they come."""

    def __missing__(self, word):
        i = self[word] = len(self) + 1
        return i


class PhraseTrie:
    """Counts of the phrases of up to ``longest`` words in one language."""

    def __init__(self, longest: int, burst: int = BURST):
        self.longest, self.burst, self.bits = longest, burst, 63 // longest
        self.ids, self.root, self.sizes, self.entries = _Ids(), Node(), {}, 0

    def full(self, more: int) -> bool:
        """Whether so many more words could be too many to number."""
        return len(self.ids) + more >= 1 << self.bits

    def add(self, words: list[bytes], piece: np.ndarray, new: int, sizes: range, fits: np.ndarray | None = None) -> None:
        """Count the phrases of these sizes inside pieces that end at ``words[new:]``; of those of the last size the ones whose start ``fits``."""
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        keys = []
        for k in sizes:
            end = np.arange(max(new, k - 1), len(words))
            end = end[piece[end - k + 1] == piece[end]]
            if fits is not None and k == sizes[-1]:
                end = end[fits[end - k + 1]]
            key = np.zeros(len(end), np.int64)
            for i in range(k):
                key |= ids[end - k + 1 + i] << self.bits * (self.longest - 1 - i)
            keys.append(key)
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        first = keys >> self.bits * (self.longest - 1)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]]).tolist() if len(first) else [0]
        first, keys, counts = first.tolist(), keys.tolist(), counts.tolist()
        for s, e in zip(bounds[:-1], bounds[1:]):
            grown = self._put(self.root, first[s], keys[s:e], counts[s:e], 1)
            self.sizes[first[s]] = self.sizes.get(first[s], 0) + grown
            self.entries += grown

    def _put(self, above: Node, word: int, keys: list[int], counts: list[int], depth: int) -> int:
        """Count keys that share their first ``depth`` words, and return how many were new."""
        box = above.get(word)
        if box is None:
            box = above[word] = {}
        if type(box) is Node:
            shift, grown, s = self.bits * (self.longest - 1 - depth), 0, 0
            at = [k >> shift for k in keys]
            for e in range(1, len(keys) + 1):
                if e == len(keys) or at[e] != at[s]:
                    grown += self._put(box, at[s], keys[s:e], counts[s:e], depth + 1)
                    s = e
            return grown
        before = len(box)
        for k, c in zip(keys, counts):
            box[k] = box.get(k, 0) + c
        grown = len(box) - before
        if len(box) > self.burst and depth < self.longest:
            shift, node = self.bits * (self.longest - 1 - depth), Node()
            for k, c in box.items():
                node.setdefault(k >> shift, {})[k] = c
            above[word] = node
        return grown

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until ``keep`` entries are left: keys and counts, sorted by words."""
        keys, counts = [], []
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            self.entries -= self.sizes.pop(word)
            boxes = [self.root.pop(word)]
            while boxes:
                box = boxes.pop()
                if type(box) is Node:
                    boxes += box.values()
                else:
                    keys += box.keys()
                    counts += box.values()
        keys, counts = np.array(keys, np.int64), np.array(counts, np.int64)
        rank = np.zeros(len(self.ids) + 1, np.int64)
        rank[pc.sort_indices(pa.array(self.ids.keys(), pa.binary())).to_numpy() + 1] = np.arange(1, len(self.ids) + 1)
        named = np.zeros(len(keys), np.int64)
        for i in range(self.longest):
            named |= rank[keys >> self.bits * i & (1 << self.bits) - 1] << self.bits * i
        order = np.argsort(named)
        return keys[order], counts[order]

    def runs(self, lang: str, keep: int) -> Iterator[pa.RecordBatch]:
        """:meth:`spill`, spelled out."""
        keys, counts = self.spill(keep)
        spelled = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        for s in range(0, len(keys), OUT):
            part = keys[s : s + OUT]
            ids = [part >> self.bits * (self.longest - 1 - i) & (1 << self.bits) - 1 for i in range(self.longest)]
            words = [spelled.take(pa.array(x - 1, mask=x == 0)) for x in ids]
            phrase = pc.binary_join_element_wise(*words, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), phrase, pa.array(counts[s : s + OUT])], schema=_COUNTS)
        if not self.root:
            self.ids = _Ids()


def _words(clean: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of cleaned text, how many pieces have ended before each, and their hashes."""
    raw = np.frombuffer(clean, np.uint8)
    end = raw == 10
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~(end | (raw == 32))
    s, e = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    return clean.split(), np.cumsum(end, dtype=np.int64)[s], W.span_hashes(raw, s, e)


def worded(texts: Iterator[bytes], longest: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, int]]:
    """``(words, piece, hashes, new)`` of cleaned texts, about ``SLICE`` bytes at a time.

    A longer text comes in slices, each led by the last words of the one before it; ``new`` counts those.
    """
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE:
            yield *_words(b"\n".join(held)), 0
            held, size = [], 0
        if len(t) <= SLICE:
            held.append(t)
            size += len(t) + 1
            continue
        tail, of, named, ended, at = [], np.zeros(0, np.int64), np.zeros(0, np.uint64), 0, 0
        while at < len(t):
            to = len(t)
            if to > at + SLICE:  # at the last gap there, else at the next one
                to = max(t.rfind(b" ", at, at + SLICE), t.rfind(b"\n", at, at + SLICE)) + 1
                to = to or min((x for x in (t.find(b" ", at), t.find(b"\n", at)) if x >= 0), default=len(t) - 1) + 1
            words, piece, hashes = _words(t[at:to])
            words, piece, hashes = tail + words, np.concatenate([of, piece + ended]), np.concatenate([named, hashes])
            yield words, piece, hashes, len(tail)
            ended += t.count(b"\n", at, to)
            keep = len(words) - min(len(words), longest - 1)
            tail, of, named, at = words[keep:], piece[keep:], hashes[keep:], to
    if held:
        yield *_words(b"\n".join(held)), 0


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


def phrase_hashes(hashes: np.ndarray, k: int, lang: str) -> np.ndarray:
    """A hash of each ``k`` words that follow each other, by the hashes of the words."""
    return W.shingle_hashes(hashes, np.array([0, len(hashes)]), k)[0] ^ _salt(lang) if len(hashes) >= k else np.zeros(0, np.uint64)


def _hashed(k: int):
    """The hash of each ``(lang, phrase)`` of ``k`` words."""

    def run(batches):
        for b in batches:
            salts = {lang: _salt(lang) for lang in pc.unique(b.column(0)).to_pylist()}
            salt = np.array([salts[lang] for lang in b.column(0).to_pylist()], np.uint64)
            for i, j, _, _ in W.chunks(b.column(1)):
                raw = np.frombuffer(b"\n".join(b.column(1).slice(i, j - i).cast(pa.binary()).to_pylist()), np.uint8)
                inside = np.zeros(len(raw) + 2, bool)
                inside[1:-1] = (raw != 10) & (raw != 32)
                s, e = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
                h = W.shingle_hashes(W.span_hashes(raw, s, e), np.arange(0, len(s) + 1, k), k)[0]
                yield pa.RecordBatch.from_arrays([pa.array((h ^ salt[i:j]).view(np.int64))], ["hash"])

    return run


def _count(sizes: range, longest: int, most: int, burst: int, bitmaps: list[bytes] | None = None, power: int = 0):
    """Runs of counted phrases of these sizes; as the phrase without words the number of all words, where words are counted.

    With ``bitmaps``, phrases of the last size count whose beginning and end of one word less are both in them.
    """

    def fits(hashes, lang, maps):
        if maps is None:
            return None
        some = in_bitmaps(phrase_hashes(hashes, sizes[-1] - 1, lang), maps, power)
        return some[:-1] & some[1:]

    def run(batches):
        maps = [np.frombuffer(m, np.uint8) for m in bitmaps] if bitmaps else None
        tries: dict[str, PhraseTrie] = {}
        total: dict[str, int] = {}
        for b in batches:
            langs = pc.fill_null(b.column(0), "und")
            for lang in pc.unique(langs).to_pylist():
                texts = b.column(1).filter(pc.equal(langs, lang)).drop_null()
                trie = tries.setdefault(lang, PhraseTrie(longest, burst))
                step = 1 << min(19, trie.bits - 1)
                for words, piece, hashes, new in worded((x.as_buffer().to_pybytes().translate(_CLEAN) for x in texts), sizes[-1]):
                    total[lang] = total.get(lang, 0) + len(words) - new
                    for s in range(new, len(words), step):
                        if trie.full(step + longest):
                            yield from trie.runs(lang, 0)
                        lead = max(0, s - sizes[-1] + 1)
                        part = slice(lead, s + step)
                        trie.add(words[part], piece[part], s - lead, sizes, fits(hashes[part], lang, maps))
                        if sum(t.entries for t in tries.values()) > most:
                            for name, t in tries.items():
                                yield from t.runs(name, t.entries // 2)
        for lang, trie in tries.items():
            if 1 in sizes:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([total.get(lang, 0)], pa.int64())], schema=_COUNTS)
            yield from trie.runs(lang, 0)

    return run, "lang string, phrase string, count long"


def phrase_counts(
    docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", most: int = MOST, burst: int = BURST
) -> DataFrame:
    """``(lang, phrase, words, count)`` of all phrases of up to ``longest`` words that occur ``least`` times or more.

    The phrase without words counts all words of its language, however few. A null language is ``und``, a null text has no words.
    The texts are read once for each size.
    """
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def frequent(sizes: range, *maps) -> DataFrame:
        run, schema = _count(sizes, longest, most, burst, *maps)
        merged = src.mapInArrow(run, schema).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
        merged = merged.filter((F.col("count") >= least) | (F.col("phrase") == ""))
        size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
        return cut(merged.select("lang", "phrase", size.cast("int").alias("words"), "count"), f"ph-{sizes[-1]}")

    out = shorter = frequent(range(1, 2))
    for k in range(2, longest + 1):
        named = shorter.filter(F.col("words") == k - 1)
        n = named.count()
        if not n:
            break
        power = min(MOST_BITS, max(15, n.bit_length() + BITS_A_PHRASE))
        maps = bitmaps_of(named.select("lang", "phrase").mapInArrow(_hashed(k - 1), "hash long"), power)
        shorter = frequent(range(k, k + 1), maps, power)
        out = out.unionByName(shorter)
    return out


def _joined(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def _scores(a, left, right):
    """``floor(1000000 * a * a / (left * right))``, exact for counts under 10 ** 15."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", (a * a).cast("decimal(30,0)") * million, left * right)


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: for each language its ``top`` phrases of 2 to ``longest`` words.

    A phrase is a run of words inside a piece of text, in lower case (A-Z only); pieces end at ``.,;:!?`` and at ends of lines.
    One that occurs ``a >= least`` times is scored by its weakest cut in two: ``a * a`` against the counts ``l`` and ``r`` of the two
    parts, in millionths, rounded down; of cuts that tie the first counts. Phrases inside a longer one with at least ``share``
    percent of their count are left out. Ranked by score, then ``a``, both descending, then the phrase's bytes. ``n`` counts
    the words of the language, that of a null language being ``und``.

    Texts may have any length; null and empty ones have no words. Rows that repeat count each. An empty table, or one
    without a phrase that is frequent enough, gives no rows; other columns are not looked at.
    """
    found = phrase_counts(docs, longest, least, lang_col, text_col)
    named = found.filter("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = named.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), _joined("w", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _joined("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.left", "s.part")
    of = found.select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))
    pairs = parts.join(of, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    weakest = pairs.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_scores(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("m"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _joined(F.col("w"), at, size)),
        )
    )
    inside = named.filter("words >= 3").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ranked = with_running(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "at")
    total = found.filter("words = 0").select("lang", F.col("count").alias("n"))
    # a table of a row a language, so that Spark knows its size
    langs = cut(ranked.groupBy("lang").agg(F.min("at").alias("begin")).join(total, "lang"), "ph-languages")
    best = ranked.join(langs, "lang").withColumn("rank", F.col("at") - F.col("begin") + 1).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    """The first 2000 phrases of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10),
x AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
h AS (SELECT x.lang, x.phrase, a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM h),
u AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
v AS (SELECT lang, phrase, max(longer) AS longer FROM u GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN v USING (lang, phrase) WHERE best = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rnk FROM o)
SELECT q.lang, rnk AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN t USING (lang) WHERE rnk <= 2000
"""
