"""Connected components by contraction of stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracewell.scratch import cut, drop


#: Vertices that are joined by broadcast: as many as can have more than a part of all edges each.
MOST_HUBS, LEAST_DEGREE = 100_000, 1000


def _number(name: Column, seed: int) -> Column:
    """A number for a vertex that is none."""
    return F.xxhash64(F.lit(seed), name)


def _hubs(rows: int, most: int | None) -> int | None:
    """From how many rows on a key is joined by broadcast, if any of ``rows`` has a key of ``most``."""
    bound = max(LEAST_DEGREE, (rows or 0) // MOST_HUBS)
    return bound if (most or 0) > bound else None


def _joined(rows: DataFrame, key: str, other: str, table: DataFrame, bound: int | None) -> DataFrame:
    """``rows`` with ``m`` of ``table (x, n, m)`` by ``key``, null where it has none.

    A key with more than a hundred-thousandth of the rows would be one hot key. There are at most ``MOST_HUBS`` of those, so
    they are joined by broadcast, where the rows lie; those rows are dealt by ``other`` after that, and what they find there is not used.
    """
    if bound is None:
        return rows.join(table.select(F.col("x").alias(key), "m"), key, "left")
    hubs = table.filter(F.col("n") > bound).select(F.col("x").alias(key), F.col("m").alias("_hub"))
    rows = rows.join(F.broadcast(hubs), key, "left").withColumn("_at", F.when(F.col("_hub").isNull(), F.col(key)).otherwise(F.col(other)))
    few = table.filter(F.col("n") <= bound).select(F.col("x").alias("_at"), "m")
    return rows.join(few, "_at", "left").withColumn("m", F.coalesce("_hub", "m")).drop("_at", "_hub")


def _near(ends: DataFrame) -> DataFrame:
    """Vertices of pairs ``(x, n)`` with their least and greatest neighbour, the least by hash, and the number of pairs. A vertex isn't its own neighbour.

    Where ends have names, ``name`` is that of the vertex, and ``two`` says that it has another one. Spark then sorts numbers on either side
    of the shuffle, so that many of them need no large tables of hashes.
    """
    other = F.col("n") != F.col("x")
    n = F.when(other, F.col("n"))
    least = F.min(F.when(other, F.xxhash64("n"))).alias("m")
    names = [F.min("name").alias("name"), (F.min("name") != F.max("name")).alias("two")] if "name" in ends.columns else []
    return ends.groupBy("x").agg(*names, F.min(n).alias("lo"), F.max(n).alias("hi"), least, F.count("*").alias("n"))


def _both(edges: DataFrame, *names: str) -> DataFrame:
    """Pairs ``(u, v)`` seen from either end, with the name of that end where ends have ``names``."""
    sides = [F.struct(F.col(x).alias("x"), F.col(n).alias("n"), *[F.col(c).alias("name") for c in names[i : i + 1]]) for i, (x, n) in enumerate(("uv", "vu"))]
    return edges.select(F.inline(F.array(*sides)))


def _least() -> Column:
    """Where a vertex goes in a round for all: to the least by hash of its neighbours and itself. Hashes of longs are a permutation of them, so they are the numbers from there on."""
    return F.least(F.xxhash64("x"), F.col("m"))


def _star(edges: DataFrame, near: DataFrame, leaves: bool, bound: int | None) -> DataFrame:
    """The pairs that are left between stars: after each vertex of one neighbour went to that, or each vertex to the least around it."""
    table = near.filter("lo != hi").select("x", "n", F.col("x").alias("m")) if leaves else near.select("x", "n", _least().alias("m"))
    for end, other in ("uv", "vu"):
        edges = _joined(edges, end, other, table, bound).filter("m is not null").select(F.col("m").alias(end), other)
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _roots(levels: list[tuple[DataFrame, bool, int | None]]) -> DataFrame:
    """The vertices of the first level with ``m``, equal for those that ended in the same vertex, from the last round back."""
    found, later = None, 0

    def last(c: Column) -> Column:
        for _ in range(later):
            c = F.xxhash64(c)
        return c

    for near, leaves, bound in reversed(levels):
        if leaves:
            known = near.filter("lo != hi").select("x", "n")
            known = known.withColumn("m", last(F.col("x"))) if found is None else known.join(found.select("x", "m"), "x", "left").withColumn("m", F.coalesce("m", last(F.col("x"))))
            # a vertex of one neighbour that isn't known either is one of a pair
            to, alone = F.when(F.col("lo") != F.col("hi"), F.col("x")).otherwise(F.coalesce("lo", "x")), F.least("x", "lo")
        else:
            known, to, alone = found, _least(), _least()
        rows = near.select("x", *[c for c in near.columns if c == "name"], to.alias("_to"), last(alone).alias("_alone"))
        if known is None:
            found = rows.withColumnRenamed("_alone", "m").drop("_to")
        else:
            if bound is not None and not leaves:
                known = known.select("x", "m").join(rows.groupBy(F.col("_to").alias("x")).agg(F.count("*").alias("n")), "x")
            found = _joined(rows, "_to", "x", known, bound).withColumn("m", F.coalesce("m", "_alone")).drop("_to", "_alone")
        later += not leaves
    return found


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_iter: int = 40) -> DataFrame:
    """``(vertex, component)`` for every vertex that has an edge.

    ``component`` is the smallest vertex that can be reached. Edges are undirected;
    self loops keep their vertex, null ends and repeated edges are ignored.

    Vertices are longs on the way, by hash if they are none; hashes that meet are seen, and taken anew. In a round each vertex goes
    to a neighbour, and the pairs between different ones are all that the next round reads: where half of the vertices or more have one neighbour, those go to it,
    otherwise all go to the least around them, in another random order each round. Either way about half of the vertices are left at
    most, so all rounds together cost little more than the first. Tables of a round are written to the shared
    folder so that lineage stays short and a lost executor costs one round.
    Numbers that are stars around their least one already take no round.
    Raises if ``max_iter`` rounds don't suffice (the number of rounds grows with
    the logarithm of the largest component).
    """
    raw = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna(), "cc-edges")
    named, seed = not all(isinstance(f.dataType, T.IntegralType) for f in raw.schema), 0
    name = F.col("name") if named else F.col("x").cast(raw.schema["a"].dataType)
    open_ = F.count_if((F.col("lo") < F.col("x")) & (F.col("lo") != F.col("hi")))
    counts = [F.count("*").alias("all"), F.count_if(F.col("lo") == F.col("hi")).alias("leaves"), open_.alias("open"), F.max("n").alias("most"), F.sum("n").alias("rows")]
    levels, now, i = [], None, 0
    while now is None or not now.isEmpty():
        if i == max_iter:
            raise RuntimeError(f"components did not settle in {max_iter} rounds")
        if now is None:
            ids = [_number(F.col(c), seed) if named else F.col(c).cast("long") for c in "ab"]
            pairs = raw.select(*[x.alias(c) for x, c in zip(ids, "uv")], "a", "b")
            near = cut(_near(_both(pairs, "a", "b") if named else _both(pairs)), "cc-near")
            if named and not near.filter("two").isEmpty():
                drop(near)
                seed += 1
                continue
            pairs = pairs.filter("u != v").select("u", "v")
        else:
            near, pairs = cut(_near(_both(now)), f"cc-near-{i}"), now
        s = near.agg(*counts).first()
        if not levels and not named and not s["open"]:
            drop(raw)
            return near.select(name.alias("vertex"), F.least("x", "lo").cast(raw.schema["a"].dataType).alias("component"))
        levels.append((near, 2 * s["leaves"] >= s["all"], _hubs(s["rows"], s["most"])))
        i += 1
        nxt = cut(_star(pairs, *levels[-1]), f"cc-{i}")
        drop(raw if now is None else now)
        now = nxt
    roots = cut(_roots(levels).select(name.alias("name"), F.col("m").alias("root")), "cc-roots")
    least = cut(roots.groupBy(F.col("root").alias("x")).agg(F.min("name").alias("m"), F.count("*").alias("n")), "cc-least")
    for t in (now, *[near for near, *_ in levels]):
        drop(t)
    s = least.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    bound = _hubs(s["rows"], s["most"])
    each = roots if bound is None else roots.withColumn("_other", F.xxhash64("name"))
    return _joined(each, "root", "_other", least, bound).select(F.col("name").alias("vertex"), F.col("m").alias("component"))
