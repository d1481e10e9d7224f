"""Near-duplicate documents by a chosen-path set-similarity join.

A document is the set of its distinct word shingles. Documents branch down
independent random trees: a node sends each of its documents to the children named
by the document's minwise token under the coordinates that the node selects (one,
sometimes two, 1 / similarity on average). Nodes that have become small are compared
exhaustively, larger ones branch again. Whatever a tree brings together is
confirmed on full shingle sets.

The steps, each of them a Spark job that writes to the shared folder:

1. One pass over the texts gives each document its set size, a hash of its set and
   its minwise sketch. Equal sets are one vertex from here on, so a group of exact
   copies never meets in one task.
2. Trees, level by level, over ``(node, set)`` pairs; sketches travel only with
   sets that share a node.
3. In small nodes, sketches rule out pairs that can't reach the similarity. The pairs
   left form coarse clusters, which hold every link that any tree has found.
4. The texts of clustered sets, and no others, are shipped to their cluster (to their
   tree nodes, where a cluster is too large for one task) and compared exactly
   through an inverted index.
5. Components of the exact links. Those of clusters that were compared as a whole are finished stars, so where all are, this takes no round.

Nodes that are still large at ``max_depth`` hold sets that agree on many coordinates, most of them copies of one
text with few changes. Such a node is one coarse cluster. Its texts are compared inside blocks, each with the same few
pivots, which links most of them. If few are left that are not linked to most of the node, they are compared with all of it,
in pairs of blocks. If many are, the node has no such majority: its texts share a long passage, say, and little else. Then each set is looked up by its
rarest shingles: of two sets at the similarity, both have a common one among the first ``n - ceil(similarity * n) + 1`` of the node's order from
rare to frequent. What all share comes last in that order, so the groups of sets with a common rare shingle are small; sketches rule out pairs in them, and
the texts of what is left are compared. So what is shipped grows with the node, not with its square, but where very many sets share
rare shingles and are unlike all the same: their sketches are compared in pairs of blocks. No cap loses a link.

Recall: a pair at the threshold stays together down one tree with probability 0.80 after one level, 0.46 after five
and 0.27 after twelve; with twelve trees it is missed with a probability of 4e-9, 6e-4 and 0.02. Deep nodes hold sets of
which each has many others alike, and a set needs one link that is found. On the given tables there is no difference to
SQL. The sketch filter drops a pair at the threshold with a probability of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words
from tracewell.llm.rows import keep_rows, row_hash
from tracewell.operators.components import connected_components
from tracewell.scratch import cut, drop

ROOTS = 12
SKETCH = 128
PIVOTS = 16
_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**32, (SKETCH, 1), dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, (SKETCH, 1), dtype=np.uint32) | np.uint32(1)


def _sketch(h: np.ndarray) -> bytes:
    """Minwise tokens of ``ROOTS`` coordinates in full, then 16 bits of each coordinate."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    least, roots = None, None
    for i in range(0, len(x), 4096):  # long texts in steps
        y = (x[None, i : i + 4096] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        m = y.min(1)
        at = h[i + y[:ROOTS].argmin(1)]
        if least is None:
            least, roots = m, at
        else:
            roots = np.where(m[:ROOTS] < least[:ROOTS], at, roots)
            least = np.minimum(least, m)
    short = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return roots.tobytes() + short.tobytes()


def _set_key(h: np.ndarray) -> int:
    """A hash of a set of shingle hashes, below 2**63."""
    total = words.mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(words.mix(np.array([total + np.uint64(len(h))]))[0] >> np.uint64(1))


def _sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for i, j, data, offsets in words.chunks(column):
        lower = words.LOWER[data]
        s, e, first = words.word_spans(lower, offsets)
        h, at = words.shingle_hashes(words.span_hashes(lower, s, e), first, k)
        for r in range(j - i):
            yield np.unique(h[at[r] : at[r + 1]])


def _describe(k: int, id_type: str):
    def run(batches):
        for b in batches:
            size, key, sketch = [], [], []
            for h in _sets_of(b.column(1), k):
                size.append(len(h))
                key.append(_set_key(h) if len(h) else None)
                sketch.append(_sketch(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(sketch, pa.binary())],
                ["id", "row", "n", "key", "sketch"],
            )

    return run, f"id {id_type}, row long, n long, key long, sketch binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by their first column."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(g, g[-1], "left"))
        if last == 0 and kept and kept[-1].column(0)[-1].as_py() == g[-1]:
            kept.append(b)
            continue
        if kept or last:
            head = [*kept, b.slice(0, last)] if last else kept
            yield pa.Table.from_batches(head)
        kept = [b.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of ``n`` vertices."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(sketch: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs inside groups whose sketches agree on ``least`` coordinates or more."""
    left, right = [], []
    pend: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a, b = (np.concatenate(x) for x in zip(*pend))
        ok = (sketch[a] == sketch[b]).sum(1) >= least
        left.append(a[ok])
        right.append(b[ok])
        pend.clear()

    for s, e in zip(bounds[:-1], bounds[1:]):
        m = e - s
        if m < 2:
            continue
        if m <= 48:
            a, b = np.triu_indices(m, 1)
            pend.append((a + s, b + s))
            size += len(a)
            if size > 40_000:
                flush()
                size = 0
        else:
            for i in range(s, e - 1):
                ok = np.flatnonzero((sketch[i + 1 : e] == sketch[i]).sum(1) >= least) + i + 1
                left.append(np.full(len(ok), i))
                right.append(ok)
    if pend:
        flush()
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _candidates(least: int):
    """Star edges of the candidate graph inside each node, from rows sorted by node."""

    def run(batches):
        for t in _runs(batches):
            node, key = (t.column(i).to_numpy() for i in (0, 1))
            raw = t.column(2).combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(key), -1)
            sketch = np.ascontiguousarray(flat[:, 8 * ROOTS :]).view(np.uint16)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            a, b = _alike(sketch, bounds, least)
            if len(a):
                used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = _least_labels(len(used), back[: len(a)], back[len(a) :])
                far = label != np.arange(len(used))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[used[label[far]]]), pa.array(key[used[far]])], ["src", "dst"]
                )

    return run


def exact_links(sets: list[np.ndarray], part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with ``whole * intersection >= part * union``, by an inverted index."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    token, back = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(back, kind="stable")
    post = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(token)))])
    shared = np.flatnonzero(np.diff(start) > 1)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    many = np.zeros(len(token), bool)
    many[shared] = True
    a, b = [], []
    for i in range(len(sets) - 1):
        mine = back[ends[i] : ends[i + 1]]
        mine = mine[many[mine]]
        if not len(mine):
            continue
        lens = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        both = np.bincount(post[at], minlength=len(sets))[i + 1 :]
        ok = np.flatnonzero(whole * both >= part * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
        a.append(np.full(len(ok), i))
        b.append(ok)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _confirm(k: int, part: int, whole: int):
    """Star edges of the exact links inside each group, from texts sorted by group."""

    def run(batches):
        for t in _runs(batches):
            group, key = (t.column(i).to_numpy() for i in (0, 1))
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for s, e in zip(bounds[:-1], bounds[1:]):
                sets, keys = [], []
                for h, want in zip(_sets_of(t.column(2).slice(s, e - s), k), key[s:e]):
                    if len(h) and _set_key(h) == want:  # another text may have the same id
                        sets.append(h)
                        keys.append(want)
                if len(sets) < 2:
                    continue
                a, b = exact_links(sets, part, whole)
                label = _least_labels(len(sets), a, b)
                keys = np.array(keys, np.int64)
                far = label != np.arange(len(keys))
                if far.any():
                    yield pa.RecordBatch.from_arrays([pa.array(keys[label[far]]), pa.array(keys[far])], ["src", "dst"])

    return run


def _sorted_by(df: DataFrame, col: str) -> DataFrame:
    """Groups by ``col``, in each the least key first, so that it is the centre of its links."""
    return df.repartition(col).sortWithinPartitions(col, "key")


def _block(n: str, limit: int):
    """The block of a set, of about ``limit / 2`` sets each, in a group of ``n``, and how many blocks there are."""
    parts = F.ceil(F.col(n) / F.lit(max(1, limit // 2))).cast("int")
    return F.pmod(F.xxhash64("key", F.lit("block")), parts).cast("int"), parts


def _with_pivots(rows: DataFrame, limit: int) -> DataFrame:
    """Large nodes ``(node, key, n)`` as one group a block, each with the same few sets of its node besides its own."""
    mine, parts = _block("n", limit)
    own = rows.select(F.xxhash64("node", mine).alias("group"), "key")
    which = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(PIVOTS))
    pivots = rows.groupBy("node", which.alias("p")).agg(F.min("key").alias("key"), F.first("n").alias("n"))
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    return own.unionByName(pivots.select(F.xxhash64("node", "block").alias("group"), "key")).distinct()


def _left_over(rows: DataFrame, found: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared in large nodes, as sets that are linked to most of their node, by whatever path, are of its component.

    First groups in which each set that isn't meets every set of the node, for nodes with ``limit`` such sets at most; then
    the ``(node, key)`` of all other nodes that have some.
    """
    d = rows.join(found.select(F.col("vertex").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    d = cut(d, "nd-large")
    each = d.groupBy("node", "component").agg(F.count("*").alias("c"))
    most = cut(each.groupBy("node").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all")), "nd-most")
    most = most.select("node", F.col("m.component").alias("main"), (F.col("all") - F.col("m.c")).alias("others")).filter("others > 0")
    d = d.join(most, "node")
    some = d.filter(F.col("others") <= limit)
    mine, parts = _block("n", limit)
    other, other_parts = _block("others", limit)  # two at most
    few = some.filter("component <> main").select("node", "key", other.alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("b"))
    every = some.select("node", "key", F.explode(F.sequence(F.lit(0), other_parts - 1)).alias("a"), mine.alias("b"))
    groups = few.unionByName(every).select(F.xxhash64("node", "a", "b", F.lit("left over")).alias("group"), "key").distinct()
    return groups, d.filter(F.col("others") > limit).select("node", "key")


def _tokens(k: int):
    """The shingle hashes of each set, from texts that may not be its own."""

    def run(batches):
        for b in batches:
            keys, sets = [], []
            for h, want in zip(_sets_of(b.column(1), k), b.column(0).to_pylist()):
                if len(h) and _set_key(h) == want:
                    keys.append(want)
                    sets.append(h.view(np.int64))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "tokens"])

    return run


def _by_rare_tokens(rows: DataFrame, tokens: DataFrame, part: int, whole: int, limit: int) -> DataFrame:
    """Groups ``(node, key)`` of ``limit`` sets at most in which any two sets of a node at the similarity meet: those with a common token among their rarest."""
    d = cut(rows.join(tokens, "key").select("node", "key", F.size("tokens").alias("n"), F.explode("tokens").alias("t")), "nd-tokens")
    often = cut(d.groupBy("node", "t").agg(F.count("*").alias("c")), "nd-often")
    ranked = d.join(often, ["node", "t"]).groupBy("node", "key", "n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("order"))
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * part / whole) + 1).cast("int"))
    rare = ranked.select("node", "key", F.explode(F.filter(first, lambda x: x["c"] > 1)).alias("x"))
    rare = cut(rare.select(F.xxhash64("node", "x.t").alias("node"), "key"), "nd-rare")
    size = rare.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    sized = rare.join(size, "node")
    mine, parts = _block("n", limit)
    large = sized.filter(F.col("n") > limit).withColumns({"a": mine, "b": F.explode(F.sequence(F.lit(0), parts - 1))})
    pair = F.xxhash64("node", F.least("a", "b"), F.greatest("a", "b"))
    return sized.filter(F.col("n") <= limit).select("node", "key").unionByName(large.select(pair.alias("node"), "key"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    part: int = 80,
    whole: int = 100,
    limit: int = 1024,
    cluster_limit: int = 2048,
    max_depth: int = 12,
) -> DataFrame:
    """``(id, row, n_shingles, component_id, kept)`` for every row of ``docs``; ``row`` is :func:`rows.row_hash`.

    Words are lower-cased (A-Z only). Two documents are linked if
    ``whole * intersection >= part * union`` of their ``shingle``-word sets; a text
    shorter than that is one shingle. ``component_id`` is the smallest id that
    links reach. Texts without words, and nulls, have 0 shingles and are linked
    with nothing. Rows may repeat, ids too: rows of one id with different texts are
    judged apart, and ``kept`` holds for each row that has its component's id.
    A null id takes part with its text and is kept only where no other id is in
    its component. Texts may have any length and count as a whole. An empty table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_hash(id_col, text_col).alias("row"))
    run, schema = _describe(shingle, id_type)
    sets = cut(src.mapInArrow(run, schema), "nd-sets")
    reps = sets.filter("key is not null").groupBy("key").agg(F.first("sketch").alias("sketch"))
    reps = cut(reps, "nd-reps")

    roots = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sketch, {8 * i + 1}, 8)")) for i in range(ROOTS)])
    rows = reps.select("key", F.explode(roots).alias("node"))
    small, deep, made = None, None, []
    for depth in range(1, max_depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        level = cut(rows.join(sizes, "node").select("node", "key", "n"), f"nd-level{depth}")
        made.append(level)
        big = level.filter(F.col("n") > limit)
        here = level.filter(F.col("n") <= limit).select("node", "key")
        small = here if small is None else small.unionByName(here)
        if big.isEmpty():
            break
        if depth == max_depth:
            deep = big
            break
        picks = F.when(F.pmod(F.xxhash64("node", F.lit("two")), F.lit(part)) < whole - part, F.array(F.lit(1), F.lit(2)))
        picks = picks.otherwise(F.array(F.lit(1)))
        at = f"{8 * ROOTS + 1} + 2 * cast(pmod(xxhash64(node, pick), {SKETCH}) as int)"
        rows = (
            big.join(reps, "key")
            .select("node", "key", "sketch", F.explode(picks).alias("pick"))
            .select("key", F.expr(f"xxhash64(node, pick, substring(sketch, {at}, 2))").alias("node"))
        )

    # 4.5 standard deviations under the threshold
    p = part / whole
    least = int(SKETCH * p - 4.5 * (SKETCH * p * (1 - p)) ** 0.5)
    pairs = _sorted_by(small.join(reps, "key").select("node", "key", "sketch"), "node")
    near = pairs.mapInArrow(_candidates(least), "src long, dst long")
    if deep is not None:  # one cluster each
        names = cut(deep.groupBy("node").agg(F.min("key").alias("dst")), "nd-names")
        near = near.unionByName(deep.join(names, "node").select(F.col("key").alias("src"), "dst"))
    coarse = connected_components(near)

    member = coarse.select(F.col("vertex").alias("key"), F.col("component").alias("group"))
    first = sets.join(member, "key").groupBy("key", "group").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    first = cut(first, "nd-members")
    size = first.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    large = (F.col("m") > cluster_limit) | (F.col("tokens") > 2000 * cluster_limit)
    sized = cut(first.join(size, "group"), "nd-sized")
    inside = sized.filter(~large | (F.col("m") == 1)).select("key", "id", "group")
    crowd = sized.filter(large & (F.col("m") > 1)).select("key", "id")
    groups = inside.unionByName(crowd.join(small, "key").select("key", "id", F.col("node").alias("group")))
    if deep is not None:
        groups = groups.unionByName(crowd.join(_with_pivots(deep, limit), "key").select("key", "id", "group"))

    def confirmed(groups: DataFrame) -> DataFrame:
        texts = src.join(groups.withColumnRenamed("id", "rep"), F.col("id").eqNullSafe(F.col("rep")))
        return _sorted_by(texts.select("group", "key", "text"), "group").mapInArrow(_confirm(shingle, part, whole), "src long, dst long")

    def clustered(nodes: DataFrame, least: int) -> DataFrame:
        """``(key, group)`` of the coarse clusters of small nodes."""
        pairs = _sorted_by(nodes.join(reps, "key").select("node", "key", "sketch"), "node")
        near = cut(connected_components(pairs.mapInArrow(_candidates(least), "src long, dst long")), "nd-rare-coarse")
        near = near.select(F.col("vertex").alias("key"), F.col("component").alias("group"))
        m = cut(near.groupBy("group").agg(F.count("*").alias("m")), "nd-rare-sizes")
        sized = near.join(m, "group")
        wide = sized.filter(F.col("m") > cluster_limit).select("key")
        return sized.filter(F.col("m") <= cluster_limit).select("key", "group").unionByName(
            nodes.join(wide, "key", "left_semi").select("key", F.col("node").alias("group"))
        )

    links = confirmed(groups)
    if deep is not None:
        links = cut(links, "nd-links")
        rest, sparse = _left_over(deep.join(crowd.select("key"), "key", "left_semi"), cut(connected_components(links), "nd-first"), limit)
        links = links.unionByName(confirmed(rest.join(crowd, "key").select("key", "id", "group")))
        sparse = cut(sparse, "nd-sparse")
        if not sparse.isEmpty():
            named = crowd.join(sparse.select("key").distinct(), "key").withColumnRenamed("id", "rep")
            texts = src.join(named, F.col("id").eqNullSafe(F.col("rep"))).select("key", "text")
            tokens = cut(texts.mapInArrow(_tokens(shingle), "key long, tokens array<long>").dropDuplicates(["key"]), "nd-sets-of-tokens")
            nodes = cut(_by_rare_tokens(sparse, tokens, part, whole, limit), "nd-rare-nodes")
            links = links.unionByName(confirmed(clustered(nodes, least).join(crowd, "key").select("key", "id", "group")))
    final = cut(connected_components(links), "nd-final")
    for x in [*made, first, sized]:
        drop(x)

    labelled = sets.select("id", "row", "n", "key").join(
        final.select(F.col("vertex").alias("key"), "component"), "key", "left"
    ).withColumn("component", F.coalesce("component", "key"))
    # a table, so that the join below is of two plain shuffles, and Spark can split a group that many documents share
    least_id = cut(labelled.filter("component is not null").groupBy("component").agg(F.min("id").alias("least_id")), "nd-least")
    out = labelled.join(least_id, "component", "left")
    alone = F.col("component").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "row",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("least_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("least_id"))).alias("kept"),
    )


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, that with the smallest id.

    Null texts and texts without words are in no group and stay. Rows that repeat stay or go together, as do rows of one id
    in one group; a null id stays only where its group has no other. Columns stay as they are, whatever their
    names; an empty table gives no rows.
    """
    return keep_rows(docs, near_duplicates(docs).filter("kept"))


def op2_minhash_near_dedup(spark, sf_dir):
    """Every document, with its component under four-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).drop("row")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS tok FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN c ON c.doc_id = n.doc_id
"""
