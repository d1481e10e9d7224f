"""Questions to the provenance graph (Q1-Q14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rebuild_dump(rows: DataFrame, seen: DataFrame, values: DataFrame, dump_id: str) -> DataFrame:
    """Q1: ``(row_index, cells)``, the cells of each row as an array by position; empty rows stay."""
    own = seen.filter(F.col("dump_id") == dump_id)
    # only the values of this dump; the semi-join goes below the aggregate that may have made them
    known = values.join(own.select("canonical_key").distinct(), "canonical_key", "left_semi").select("canonical_key", "value")
    mine = own.join(known, "canonical_key", "left")
    cells = mine.groupBy("row_index").agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "raw", F.col("value").alias("canonical")))).alias("cells")
    )
    d = rows.filter(F.col("dump_id") == dump_id).select("row_index").join(cells, "row_index", "left")
    return d.select("row_index", F.coalesce("cells", F.expr("cast(array() as array<struct<position:int,column:string,raw:string,canonical:string>>)")).alias("cells")).orderBy("row_index")


def rebuild_wide(seen: DataFrame, dump_id: str, columns: list[str]) -> DataFrame:
    """Q2: the dump as a table of the given columns; the first position wins."""
    d = seen.filter((F.col("dump_id") == dump_id) & F.col("column").isin(*columns))
    return d.groupBy("row_index").pivot("column", columns).agg(F.min_by("raw", "position"))


def neighbours(edges: DataFrame, key: str, k: int) -> DataFrame:
    """Q3: the ``k`` values that share most rows with a value, in either direction."""
    d = edges.filter((F.col("a_key") == key) | (F.col("b_key") == key))
    other = F.when(F.col("a_key") == key, F.col("b_key")).otherwise(F.col("a_key"))
    return d.select(other.alias("key"), "count", "last_seen").orderBy(F.desc("count"), "key").limit(k)


def pair_variations(pairs: DataFrame, src: str | None = None, samples: int = 5) -> DataFrame:
    """Q4: how many targets each source has, and its most frequent ones."""
    d = pairs if src is None else pairs.filter(F.col("src_key") == src)
    w = Window.partitionBy("src_key").orderBy(F.desc("count"), "dst_key")
    top = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
    top = top.groupBy("src_key").agg(F.array_sort(F.collect_list(F.struct("r", "dst_key", "count"))).alias("t"))
    n = d.groupBy("src_key").agg(F.count_distinct("dst_key").alias("variations"))
    return n.join(top, "src_key").select("src_key", "variations", F.transform("t", lambda x: F.concat_ws("=", x["dst_key"], x["count"])).alias("samples"))


def similar_dumps(hashes: DataFrame, dump_id: str) -> DataFrame:
    """Q5: other dumps by the number of distinct rows that they share with this one."""
    mine = hashes.filter(F.col("dump_id") == dump_id).select("row_hash").distinct()
    d = hashes.filter(F.col("dump_id") != dump_id).join(mine, "row_hash", "left_semi")
    return d.groupBy("dump_id").agg(F.count_distinct("row_hash").alias("matched_rows")).orderBy(F.desc("matched_rows"), "dump_id")


def coverage(hashes: DataFrame, dump_id: str) -> DataFrame:
    """Q6: the part of this dump's distinct rows that another one has, and whether both are equal."""
    sizes = hashes.groupBy("dump_id").agg(F.count_distinct("row_hash").alias("n"))
    own = sizes.filter(F.col("dump_id") == dump_id).select(F.col("n").alias("own"), F.lit(1).alias("one"))
    d = similar_dumps(hashes, dump_id).join(sizes, "dump_id").withColumn("one", F.lit(1)).join(F.broadcast(own), "one")  # one row
    return d.select(
        "dump_id", (F.col("matched_rows") / F.col("own")).alias("coverage"),
        ((F.col("matched_rows") == F.col("own")) & (F.col("n") == F.col("own"))).alias("is_exact"),
    )


def _novelty(items: DataFrame, dumps: DataFrame, col: str) -> DataFrame:
    """The part of each dump's distinct items that no earlier dump has; of the same time, the smaller id is earlier."""
    d = items.select("dump_id", col).distinct().join(dumps.select("dump_id", "received_at"), "dump_id")
    # an item is new in one dump, so it is counted there, and nothing is joined back to it
    first = d.groupBy(col).agg(F.min(F.struct("received_at", "dump_id")).alias("f")).select(F.col("f.dump_id").alias("dump_id"), F.lit(1).alias("new"))
    all_ = d.select("dump_id", F.lit(0).alias("new"))
    return all_.unionByName(first).groupBy("dump_id").agg((F.sum("new") / F.count_if(F.col("new") == 0)).alias("novelty"))


def row_novelty(hashes: DataFrame, dumps: DataFrame) -> DataFrame:
    """Q7."""
    return _novelty(hashes, dumps, "row_hash")


def value_novelty(cells: DataFrame, dumps: DataFrame) -> DataFrame:
    """Q8."""
    return _novelty(cells, dumps, "canonical_key")


def lookup(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """Q9: one node. Over a table that :func:`~tracewell.sources.records.write_bucketed` has stored, one bucket is read, and of it the row groups that may hold the key."""
    return nodes.filter((F.col("label") == label) & (F.col("key") == key)).limit(1)


def filter_by_prop(nodes: DataFrame, label: str, prop: str, value: str) -> DataFrame:
    """Q10: nodes of a label whose property has this value."""
    return nodes.filter((F.col("label") == label) & (F.col("props")[prop] == value))


def count_by_label(nodes: DataFrame) -> DataFrame:
    """Q11."""
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def duplicate_rows(hashes: DataFrame) -> DataFrame:
    """Q12: row hashes that occur more than once, with the dumps that have them."""
    each = hashes.groupBy("row_hash", "dump_id").agg(F.count("*").alias("n"))
    d = each.groupBy("row_hash").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("dump_id")).alias("dumps"))
    return d.filter("n > 1")


def dump_overlap(hashes: DataFrame, block: int = 256) -> DataFrame:
    """Q13: shared distinct rows and their Jaccard index for all pairs of dumps that share any.

    Row hashes in the same set of dumps are counted together first, so a set of dumps
    makes its pairs once, however many rows lie in it; no frequency cap is needed. A set of more than ``block`` dumps is cut
    into blocks, and each pair of blocks is a row of its own, dealt anew, so no row makes more than ``block * block`` pairs.
    """
    d = hashes.select("dump_id", "row_hash").distinct()
    sets = d.groupBy("row_hash").agg(F.array_sort(F.collect_list("dump_id")).alias("s")).filter("size(s) > 1")
    sets = sets.groupBy("s").agg(F.count("*").alias("n"))
    d2 = _block_pairs(sets, block).select("n", F.explode(_pairs(F.col("a"), F.col("b"))).alias("p")).groupBy("p.dump_a", "p.dump_b").agg(F.sum("n").alias("shared"))
    size = d.groupBy("dump_id").agg(F.count("*").alias("k"))
    a, b = (size.select(F.col("dump_id").alias(x), F.col("k").alias(f"k_{x}")) for x in ("dump_a", "dump_b"))
    d2 = d2.join(a, "dump_a").join(b, "dump_b")
    return d2.select("dump_a", "dump_b", "shared", (F.col("shared") / (F.col("k_dump_a") + F.col("k_dump_b") - F.col("shared"))).alias("jaccard"))


def _pairs(a: Column, b: Column) -> Column:
    """Ordered pairs of two arrays; of an array with itself each pair once."""
    return F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: x < y), lambda y: F.struct(x.alias("dump_a"), y.alias("dump_b")))))


def _block_pairs(sets: DataFrame, block: int) -> DataFrame:
    """``(n, a, b)``: each sorted set of ``sets`` as pairs of its blocks, itself twice where it is one."""
    small = sets.filter(F.size("s") <= block).select("n", F.col("s").alias("a"), F.col("s").alias("b"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("s") / block).cast("int") - 1), lambda i: F.slice("s", i * block + 1, block))
    large = sets.filter(F.size("s") > block).select("n", blocks.alias("bs")).select("n", "bs", F.posexplode("bs").alias("i", "a"))
    large = large.select("n", "a", F.explode(F.slice("bs", F.col("i") + 1, F.size("bs") - F.col("i"))).alias("b"))
    return small.unionByName(large.repartition(F.col("a")[0], F.col("b")[0]))


def provenance(seen: DataFrame, key: str) -> DataFrame:
    """Q14: every place where a value was seen, in its raw form."""
    d = seen.filter(F.col("canonical_key") == key)
    return d.select("dump_id", "row_index", "column", "raw", "ts").orderBy("ts", "dump_id", "row_index", "column")
