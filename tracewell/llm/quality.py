"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is over characters: an n-gram is ``ORDER`` whole code points of 21 bits, in two longs.
It is trained on one half of all trusted documents, by a hash of their ids; the other half
gives the quantiles, as a model finds the text that it has learnt from too easy. Counts are
tables, sharded by their n-gram; lower orders count the different characters before an n-gram,
discounts come from the counts of counts. For each n-gram that was seen the model has its own
part of the probability, and for each history the part that discounting leaves to the order
below; the sum over orders is done where a text is scored.

Scoring is a join of counts. Documents are dealt into blocks of some ten megabytes, and
a block asks, once, for each n-gram that occurs in it, of every order. One join answers all
blocks, and the answers go back to their block. So what is shuffled are texts, twice and
packed by zstandard, and for each block its different n-grams; no table has to fit in one
place. A block's texts stream past its answers, so a task holds the answers and one pack.

Two things reject a document, each by a quantile of its language's trusted documents: a
perplexity above the high one, or, for text that repeats itself, a share of its surprise below
the low one that is left where an n-gram that came within ``NEAR`` characters before costs
nothing. Both are drawn to the language's median as if a document had ``PRIOR`` more characters
of that, which keeps very short texts from chance verdicts, and ``slack`` widens both limits
for languages that have few trusted documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.llm.rows import keep_rows, row_hash
from tracewell.scratch import cut, drop

ORDER, BITS, LOW = 5, 21, 3
NEAR = 200
PRIOR = 100
BLOCK_BYTES = 32 << 20
#: Blocks share partitions of a shuffle beyond so many, one after the other.
MOST_PARTITIONS = 20_000
STEP = 1 << 18
PACK = 1 << 20
_ONE = (1 << BITS) - 1
_UNKNOWN = 1.0 / (1 << BITS)  # of a character that was never seen
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# An n-gram is ``(hi, lo)``: ``lo`` holds its last LOW characters, ``hi`` those before. A character
# is its code point + 2, the padding before a text is 1, and 0 is no character, so n-grams of
# different orders differ.


def _width(k: int) -> tuple[int, int]:
    """The masks of ``hi`` and ``lo`` for the last ``k`` characters."""
    return (1 << BITS * max(0, k - LOW)) - 1, (1 << BITS * min(k, LOW)) - 1


def _suffix(hi, lo, k: int):
    a, b = _width(k)
    return hi & a, lo & b


def _history(hi, lo):
    """The n-gram without its last character."""
    return hi >> BITS, lo >> BITS | (hi & _ONE) << BITS * (LOW - 1)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of ``(row, from, to)`` of ``STEP`` characters at most; a longer text is cut."""
    some, size = [], 0
    for r, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + STEP - size)
            some.append((r, at, end))
            size += end - at
            at = end
            if size >= STEP:
                yield some
                some, size = [], 0
    if some:
        yield some


def _grams(texts: list[str], piece: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of a piece, and where each part of it starts."""
    pad = ORDER - 1
    joined = "".join(" " * max(0, pad - a) + texts[r][max(0, a - pad) : b] for r, a, b in piece)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 2
    n = np.array([b - a for _, a, b in piece], np.int64)
    first = np.cumsum(n) - n
    opens = first + np.arange(len(n)) * pad
    for (_, a, _), o in zip(piece, opens):
        cp[o : o + max(0, pad - a)] = 1
    at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * pad, n)
    out = []
    for i, j in ((0, ORDER - LOW), (ORDER - LOW, ORDER)):
        g = cp[at + i]
        for x in range(i + 1, j):
            g = g << BITS | cp[at + x]
        out.append(g)
    return out[0], out[1], first


def _hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    h = hi.view(np.uint64) * _A + lo.view(np.uint64) * _B
    return (h ^ h >> np.uint64(32)) * _A


def _runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal n-grams follow each other by position, and whether a new one begins there."""
    low = np.uint64((1 << len(lo).bit_length()) - 1)
    key = _hash(hi, lo) & ~low | np.arange(len(lo), dtype=np.uint64)
    key.sort()
    at = (key & low).view(np.int64)
    new = np.ones(len(at), bool)
    h, g = hi[at], lo[at]
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return at, new


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, new = _runs(hi, lo)
    return hi[at[new]], lo[at[new]]


def _batches(columns: list[np.ndarray], names: list[str]):
    for i in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names)


def _merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    hi, lo, n = (np.concatenate(x) for x in zip(*parts))
    at, new = _runs(hi, lo)
    return [hi[at[new]], lo[at[new]], np.add.reduceat(n[at], np.flatnonzero(new))]


def _count(batches):
    """The n-grams of a partition with their counts."""
    parts, held = [], 0
    for b in batches:
        texts = [x or "" for x in b.column(0).to_pylist()]
        for piece in _pieces(texts):
            hi, lo, _ = _grams(texts, piece)
            parts.append(_merge([[hi, lo, np.ones(len(lo), np.int64)]]))
            held += len(parts[-1][0])
            if held > 1_000_000:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 500_000:
                    yield from _batches(parts[0], ["hi", "lo", "n"])
                    parts, held = [], 0
    if parts:
        yield from _batches(_merge(parts), ["hi", "lo", "n"])


def _cut_orders(hi: Column, lo: Column, least: int) -> Column:
    """The ends of an n-gram of the highest order, from ``least`` characters on."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("k"), hi.bitwiseAND(F.lit(a)).cast("long").alias("hi"), lo.bitwiseAND(F.lit(b)).cast("long").alias("lo"))
            for k in range(least, ORDER + 1)
            for a, b in [_width(k)]
        ]
    )


def count_tables(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """``(k, hi, lo, c)``: counts of the highest order, numbers of different left neighbours below."""
    seen = trusted.select(F.col(text_col).alias("text")).mapInArrow(_count, "hi long, lo long, n long")
    top = cut(seen.groupBy("hi", "lo").agg(F.sum("n").alias("c")), "kn-top")
    some = top.select(F.explode(_cut_orders(F.col("hi"), F.col("lo"), 2)).alias("g")).select("g.*").distinct()
    below = [
        F.when(F.col("k") == k, F.col(x).bitwiseAND(F.lit(_width(k - 1)[i])))
        for i, x in enumerate(("hi", "lo"))
        for k in range(2, ORDER + 1)
    ]
    n = ORDER - 1
    lower = some.groupBy(
        (F.col("k") - 1).alias("k"), F.coalesce(*below[:n]).cast("long").alias("hi"), F.coalesce(*below[n:]).cast("long").alias("lo")
    ).agg(F.count("*").alias("c"))
    out = cut(lower.unionByName(top.select(F.lit(ORDER).alias("k"), "hi", "lo", "c")), "kn-counts")
    drop(top)
    return out


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from its counts of counts."""
    rows = counts.groupBy("k").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    out = {k: (0.5, 0.5, 0.5) for k in range(1, ORDER + 1)}
    for r in rows:  # one row an order
        n1, n2, n3, n4 = (r[f"n{i}"] for i in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            out[r["k"]] = tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))
    return out


def model(counts: DataFrame) -> DataFrame:
    """``(hi, lo, own, left)``: the own part of an n-gram's probability, and what a history leaves to the order below.

    A history is followed by as many n-grams as there are characters at most.
    """
    off, c = discounts(counts), F.col("c")
    each = [F.coalesce(*[F.when(F.col("k") == k, F.lit(d[i])) for k, d in off.items()]) for i in range(3)]
    less = F.when(c == 1, each[0]).when(c == 2, each[1]).otherwise(each[2])
    # of the n-gram without its last character
    before = F.shiftright("hi", BITS), F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(_ONE)), BITS * (LOW - 1)))
    rows = counts.select("k", "hi", "lo", "c", less.alias("less"), *[x.cast("long").alias(n) for x, n in zip(before, ("h_hi", "h_lo"))])
    w = Window.partitionBy("k", "h_hi", "h_lo")
    rows = rows.withColumns(
        {"total": F.sum("c").over(w), "free": F.sum("less").over(w), "n": F.row_number().over(w.orderBy("hi", "lo"))}
    )
    none = F.lit(None).cast("float")
    own = F.struct("hi", "lo", ((c - F.col("less")) / F.col("total")).cast("float").alias("own"), none.alias("left"))
    left = F.struct(F.col("h_hi").alias("hi"), F.col("h_lo").alias("lo"), none.alias("own"), (F.col("free") / F.col("total")).cast("float").alias("left"))
    both = F.when(F.col("n") == 1, F.array(own, left)).otherwise(F.array(own))
    out = rows.select(F.explode(both).alias("x")).select("x.*")
    return out.groupBy("hi", "lo").agg(F.max("own").alias("own"), F.max("left").alias("left"))


def _pack(batches):
    """Rows of a batch that go to one block, as one compressed Arrow stream."""
    how = pa.ipc.IpcWriteOptions(compression="zstd")
    for whole in batches:
        block = whole.column("block").to_numpy()
        for at in _by_size(whole, np.argsort(block, kind="stable"), block):
            sink = io.BytesIO()
            part = whole.take(pa.array(at)).drop_columns(["block"])
            with pa.ipc.new_stream(sink, part.schema, options=how) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array(block[at[:1]]), pa.array([sink.getvalue()], pa.binary())], ["block", "pack"])


def _by_size(whole: pa.RecordBatch, order: np.ndarray, block: np.ndarray):
    """Runs of ``order`` inside one block and, but for single rows, of ``PACK`` bytes at most."""
    size = pa.compute.binary_length(whole.column("text")).fill_null(0).to_numpy(zero_copy_only=False)[order]
    some, held = [], 0
    for k, (r, n) in enumerate(zip(order, size)):
        if some and (block[r] != block[some[-1]] or held + n > PACK):
            yield np.array(some)
            some, held = [], 0
        some.append(r)
        held += n
    if some:
        yield np.array(some)


def _unpack(pack: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer()).read_all()


def _ask(batches):
    """The different n-grams of each block, of all orders, sorted; packs come block by block."""
    block, parts = None, []

    def asked():
        hi, lo = _looked_up(*_distinct(*(np.concatenate(x) for x in zip(*parts))))
        order = np.lexsort((lo, hi))
        yield from _batches([np.full(len(order), block, np.int32), hi[order], lo[order]], ["block", "hi", "lo"])

    for b in batches:
        for k, pack in zip(b.column("block").to_pylist(), b.column("pack")):
            if k != block:
                if parts:
                    yield from asked()
                block, parts = k, []
            texts = [x or "" for x in _unpack(pack).column("text").to_pylist()]
            for piece in _pieces(texts):
                parts.append(_distinct(*_grams(texts, piece)[:2]))
                if sum(len(x[0]) for x in parts[1:]) > 500_000:
                    parts[:] = [_distinct(*(np.concatenate(x) for x in zip(*parts)))]
    if parts:
        yield from asked()


def _looked_up(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of distinct n-grams of the highest order, and of their histories, of all lengths from none on."""
    parts, own, before = [(hi, lo)], (hi, lo), _history(hi, lo)
    for k in range(ORDER - 1, -1, -1):
        own, before = _distinct(*_suffix(*own, k)), _distinct(*_suffix(*before, k))
        parts += [own, before]
    return _distinct(*(np.concatenate(x) for x in zip(*parts)))


class _Block:
    """What a block knows: the model's answers by the hash of an n-gram, and the costs of those it has met."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.float32)] * 2
        hi, lo, own, left = (np.concatenate(x) for x in zip(*(parts or [none])))
        h = _hash(hi, lo)
        order = np.argsort(h)
        # the last entry answers for whatever isn't there
        self.h, self.own, self.left = h[order], np.append(own[order], np.nan), np.append(left[order], np.nan)
        self.met, self.costs = np.zeros(0, np.uint64), np.zeros(0)

    def _answer(self, of: np.ndarray, gram: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        h = _hash(*gram)
        at = np.searchsorted(self.h, h)
        found = at < len(self.h)
        found[found] = self.h[at[found]] == h[found]
        return of[np.where(found, at, len(self.h))].astype(float)

    def _cost(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Minus log probability of n-grams of the highest order, summed up from the lowest."""
        p, before = np.full(len(lo), _UNKNOWN), _history(hi, lo)
        for k in range(1, ORDER + 1):
            own = np.nan_to_num(self._answer(self.own, _suffix(hi, lo, k)))
            left = self._answer(self.left, _suffix(*before, k - 1))
            p = np.where(np.isnan(left), p, own + left * p)  # a history that was never seen says nothing
        return -np.log(p)

    def costs_of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        h = _hash(hi, lo)
        if len(self.met):
            fresh = self.met[np.minimum(np.searchsorted(self.met, h), len(self.met) - 1)] != h
        else:
            fresh = np.ones(len(h), bool)
        if fresh.any():
            met = np.concatenate([self.met, h[fresh]])
            costs = np.concatenate([self.costs, self._cost(hi[fresh], lo[fresh])])
            order = np.argsort(met)
            self.met, self.costs = met[order], costs[order]
        return self.costs[np.searchsorted(self.met, h)]

    def score(self, rows: pa.Table, id_type: pa.DataType, lang_type: pa.DataType) -> pa.RecordBatch:
        texts = [x or "" for x in rows.column("text").to_pylist()]
        total, fresh = np.zeros(len(texts)), np.zeros(len(texts))
        for piece in _pieces(texts):
            hi, lo, first = _grams(texts, piece)
            at, new = _runs(hi, lo)
            begins = np.flatnonzero(new)
            each = self.costs_of(hi[at[begins]], lo[at[begins]])
            cost = np.empty(len(at))
            cost[at] = np.repeat(each, np.diff(np.append(begins, len(at))))
            row = np.array([r for r, _, _ in piece])
            total += np.bincount(row, np.add.reduceat(cost, first), len(texts))
            # the same n-gram a few characters before, in the same text
            again = np.flatnonzero(~new[1:] & (at[1:] - at[:-1] <= NEAR)) + 1
            start = np.repeat(first, np.diff(np.append(first, len(at))))
            again = again[at[again - 1] >= start[at[again]]]
            cost[at[again]] = 0.0
            fresh += np.bincount(row, np.add.reduceat(cost, first), len(texts))
        column = lambda c, kind: rows.column(c).combine_chunks().cast(kind)
        n = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [column("id", id_type), column("row", pa.int64()), column("lang", lang_type), n, pa.array(total), pa.array(fresh)],
            ["id", "row", "lang", "n", "cost", "fresh"],
        )


def _score(id_type: pa.DataType, lang_type: pa.DataType):
    def run(batches):
        block, parts, known = None, [], None
        for b in batches:
            answer = b.column("pack").is_null()
            for x in pa.Table.from_batches([b]).select(["block"]).column(0).unique().to_pylist():
                own = pa.compute.equal(b.column("block"), x)
                if x != block:
                    block, parts, known = x, [], None
                got = b.filter(pa.compute.and_(own, answer))
                if got.num_rows:
                    parts.append(tuple(got.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "own", "left")))
                packs = b.filter(pa.compute.and_(own, pa.compute.invert(answer))).column("pack")
                if len(packs):
                    known = known or _Block(parts)
                    for pack in packs:
                        yield known.score(_unpack(pack), id_type, lang_type)

    return run


def perplexities(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``(id, row, lang, n, cost, fresh)``: characters, minus log probability, and that without near repeats, of every row.

    ``known`` is what :func:`model` returns. The number of blocks follows the size of the
    texts, and is at least twice that of the cores; a shuffle has ``MOST_PARTITIONS`` partitions at most, each of many blocks then.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(-(-size // BLOCK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    rows = docs.select(
        F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("row"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
    )
    rows = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int"))
    packs = rows.mapInArrow(_pack, "block int, pack binary")
    parts = min(blocks, MOST_PARTITIONS)
    dealt = lambda df: df.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))
    asked = cut(dealt(packs).sortWithinPartitions("block").mapInArrow(_ask, "block int, hi long, lo long"), "kn-asked")
    answers = asked.join(known, ["hi", "lo"]).withColumn("pack", F.lit(None).cast("binary"))
    none = {"hi": "long", "lo": "long", "own": "float", "left": "float"}
    both = answers.unionByName(packs.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}))
    # a block's answers come first, then its texts
    both = dealt(both).sortWithinPartitions("block", F.col("pack").isNotNull())
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row long, lang {docs.schema[lang_col].dataType.simpleString()}, n long, cost double, fresh double"
    types = to_arrow_schema(docs.select(id_col, lang_col).schema)
    out = cut(both.mapInArrow(_score(types.field(0).type, types.field(1).type), schema), "kn-scores")
    drop(asked)
    return out


def _quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A language's quantiles of positive values, to a thousandth of their logarithms, which bounds what a group keeps."""
    bins = rows.select("lang", *[F.ceil(F.log(v) * 1000).alias(k) for k, (v, _) in wanted.items()])
    each = [F.exp(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {k})") / 1000).alias(k) for k, (_, q) in wanted.items()]
    return bins.groupBy("lang").agg(*each)


def classify_quality(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995,
    slack: float = 1.05,
) -> DataFrame:
    """``(id, row, lang, n, perplexity, fresh_share, least, most, keep)`` for every row of ``docs``.

    ``trusted_ids`` names the documents to learn from, all of them. Texts without characters (nulls,
    empty ones) have no perplexity and are kept, as are languages without trusted text (null is a
    language). Without any trusted text nothing is rejected. Rows that repeat are scored
    alike; a null id can't be trusted. Texts of any length are scored whole, a megabyte at
    a time. An empty table gives no rows; other columns are not looked at.
    """
    ids = trusted_ids.select(F.col(id_col).alias("_t")).dropna().distinct()
    # the model learns from one half of the trusted documents, the quantiles from the other
    half = F.pmod(F.xxhash64("_t"), F.lit(2)) == 0
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = count_tables(own.join(ids.filter(half), F.col("id") == F.col("_t"), "left_semi"))
    known = cut(model(counts), "kn-model")
    scored = perplexities(docs, known, id_col, text_col, lang_col)
    for table in (counts, known):
        drop(table)
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(F.col("cost") / F.col("n"))))
    scored = scored.withColumn("fresh_share", F.when(F.col("n") > 0, F.col("fresh") / F.col("cost")))
    held = scored.join(ids.filter(~half), F.col("id") == F.col("_t"), "left_semi").filter("n > 0")
    middle = _quantiles(held, {"m": (F.col("perplexity"), 0.5), "share_m": (F.col("fresh_share"), 0.5)})
    middle = cut(middle.withColumnRenamed("lang", "_lang"), "kn-median")
    prior = F.lit(PRIOR) * F.log("m")
    drawn = F.exp((F.col("cost") + prior) / (F.col("n") + PRIOR))
    share = (F.col("fresh") + prior * F.col("share_m")) / (F.col("cost") + prior)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    limit = _quantiles(held.join(middle, same("lang", "_lang")), {"most": (drawn, quantile), "least": (share, 1 - quantile)})
    limit = limit.select("lang", F.col("least") / slack, F.col("most") * slack).toDF("lang", "least", "most")
    limits = cut(middle.join(limit, same("_lang", "lang")).drop("lang"), "kn-limits")
    out = scored.join(limits, same("lang", "_lang"), "left")
    keep = F.coalesce((drawn <= F.col("most")) & (share >= F.col("least")), F.lit(True)) | (F.col("n") == 0)
    return out.select(
        F.col("id").alias(id_col), "row", F.col("lang").alias(lang_col), "n", "perplexity", "fresh_share", "least", "most", keep.alias("keep")
    )


def trusted(spark, sf_dir: str) -> DataFrame:
    """Documents that the labels call good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject.

    Null and empty texts stay, as do all documents of a language without trusted text. Rows that
    repeat go or stay together, a null id is judged by its text. Columns stay as they are, whatever
    their names; an empty table gives no rows.
    """
    decided = classify_quality(docs, trusted(spark, sf_dir))
    return keep_rows(docs, decided.filter("keep"))


def op8_quality_classifier(spark, sf_dir):
    """The perplexity and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify_quality(docs, trusted(spark, sf_dir)).drop("row")
