"""The provenance graph as tables (G1-G18), built from cells with a canonical key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.operators.components import connected_components
from tracewell.scratch import cut


def field_values(cells: DataFrame) -> DataFrame:
    """G1: one row for each canonical key, value and time of the first sight."""
    return cells.groupBy("canonical_key").agg(F.min(F.struct("ts", "canonical")).alias("f")).select(
        "canonical_key", F.col("f.canonical").alias("value"), F.col("f.ts").alias("created_at")
    )


def fields(cells: DataFrame) -> DataFrame:
    """The distinct columns."""
    return cells.select(F.col("column").alias("name")).distinct()


def value_of(cells: DataFrame) -> DataFrame:
    """Distinct pairs of value and field."""
    return cells.select("canonical_key", F.col("column").alias("name")).distinct()


def dump_nodes(cells: DataFrame) -> DataFrame:
    """Dumps with their earliest time."""
    return cells.groupBy("dump_id").agg(F.min("ts").alias("received_at"))


def row_nodes(cells: DataFrame) -> DataFrame:
    """Rows of dumps, and how many cells they have."""
    return cells.groupBy("dump_id", "row_index").agg(F.count("*").alias("n_cells"))


def sightings(cells: DataFrame) -> DataFrame:
    """A node for each cell, with an id that depends on its place alone."""
    place = F.concat_ws("|", "dump_id", "row_index", "column", "position")
    return cells.select(
        F.sha2(place, 256).alias("sighting_id"), "dump_id", "row_index", "column", "position", "raw", "canonical_key", "ts"
    )


def row_hashes(cells: DataFrame, salt: str, version: int = 1) -> DataFrame:
    """The salted hash of a row's sorted set of keys. A row is one group of at most its columns."""
    keys = F.concat_ws("|", F.array_sort(F.collect_set("canonical_key")))
    return cells.groupBy("dump_id", "row_index").agg(
        F.sha2(F.concat_ws(":", F.lit(salt), F.lit(f"v{version}"), keys), 256).alias("row_hash")
    )


def dump_row_hashes(hashes: DataFrame) -> DataFrame:
    """Distinct row hashes of each dump."""
    return hashes.select("dump_id", "row_hash").distinct()


def _pairs_in_rows(cells: DataFrame, pairs: list[tuple[str, str]] | None) -> DataFrame:
    """Unordered pairs of distinct keys in a row, once each; a row is gathered, never a key."""
    keep = cells if pairs is None else cells.filter(F.col("column").isin(*{c for p in pairs for c in p}))
    rows = keep.groupBy("dump_id", "row_index").agg(
        F.array_sort(F.collect_set(F.struct("canonical_key", "column"))).alias("c"), F.max("ts").alias("ts")
    )
    def meets(x, y):
        ok = x["canonical_key"] < y["canonical_key"]
        if pairs is None:
            return ok
        both = [((x["column"] == a) & (y["column"] == b)) | ((x["column"] == b) & (y["column"] == a)) for a, b in pairs]
        any_ = both[0]
        for b in both[1:]:
            any_ = any_ | b
        return ok & any_

    found = F.flatten(
        F.transform("c", lambda x: F.transform(F.filter("c", lambda y: meets(x, y)), lambda y: F.struct(x["canonical_key"].alias("a"), y["canonical_key"].alias("b"))))
    )
    return rows.select(F.explode(F.array_distinct(found)).alias("p"), "ts").select("p.a", "p.b", "ts")


def co_occurs(cells: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(a_key, b_key, count, last_seen)``, ``a_key < b_key``, of values that share rows.

    With ``pairs`` only between the fields named. Pairs are made inside each row, so a
    value that is in most rows needs no join; counts combine before the shuffle.
    """
    return _pairs_in_rows(cells, pairs).groupBy(F.col("a").alias("a_key"), F.col("b").alias("b_key")).agg(
        F.count("*").alias("count"), F.max("ts").alias("last_seen")
    )


def add_counts(edges: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Counts added, the later time kept."""
    return edges.unionByName(delta).groupBy(*keys).agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def pair_edges(cells: DataFrame, pairs: list[tuple[str, str, str]], max_samples: int = 5) -> DataFrame:
    """Directed edges ``(pair_type, from field, to field)`` inside rows, with count, time and samples.

    Samples are the smallest ``max_samples`` names ``dump:row``, in order; each task keeps no more than that of an
    edge before they are shuffled.
    """
    rows = cells.filter(F.col("column").isin(*{c for _, a, b in pairs for c in (a, b)})).groupBy("dump_id", "row_index").agg(
        F.collect_set(F.struct("column", "canonical_key")).alias("c"), F.max("ts").alias("ts")
    )
    def of(name):
        return F.transform(F.filter("c", lambda x: x["column"] == name), lambda x: x["canonical_key"])

    def edges(kind, a, b):
        return F.flatten(F.transform(of(a), lambda s: F.transform(of(b), lambda t: F.struct(F.lit(kind).alias("pair_type"), s.alias("src_key"), t.alias("dst_key")))))

    made = F.flatten(F.array(*[edges(*p) for p in pairs]))
    d = rows.select(F.explode(made).alias("e"), "ts", F.concat_ws(":", "dump_id", F.lpad(F.col("row_index").cast("string"), 12, "0")).alias("at"))
    d = cut(d.select("e.*", "ts", "at"), "pair-edges")  # used twice, gathered once
    edge = ["pair_type", "src_key", "dst_key"]
    counts = d.groupBy(*edge).agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"))
    nth = F.row_number().over(Window.partitionBy(*edge).orderBy("at"))
    few = d.select(*edge, "at").withColumn("_n", nth).filter(F.col("_n") <= max_samples)
    return counts.join(few.groupBy(*edge).agg(F.array_sort(F.collect_list("at")).alias("samples")), edge)


def upsert_props(base: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(label, key, props)`` after all ``(label, key, props, seq)`` jobs.

    The latest job wins for each property, a null removes it; a node without properties stays.
    ``base`` is overlaid by all jobs.
    """
    both = base.select("label", "key", "props", F.lit(-1).cast("long").alias("seq")).unionByName(jobs.select("label", "key", "props", F.col("seq").cast("long")))
    each = both.select("label", "key", "seq", F.explode_outer("props").alias("p", "v"))
    last = each.groupBy("label", "key", "p").agg(F.max(F.struct("seq", F.struct(F.col("v").isNull().alias("gone"), "v"))).alias("m"))
    entry = F.when(F.col("p").isNotNull() & ~F.col("m.col2.gone"), F.struct("p", F.col("m.col2.v").alias("v")))
    return last.groupBy("label", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("props"))


def upsert_versions(base: DataFrame, jobs: DataFrame) -> DataFrame:
    """G13 for a stored table ``(label, key, props, seqs)``, which keeps the sequence of each property.

    So jobs may come in any order and in any batches: an older one never overlays a newer one, and a removed property
    stays removed (its sequence stays). A job without properties makes its node.
    """
    stored = base.select("label", "key", F.explode_outer("seqs").alias("p", "seq"), "props").select(
        "label", "key", "seq", "p", F.try_element_at("props", F.col("p")).alias("v")
    )
    new = jobs.select("label", "key", F.col("seq").cast("long"), F.explode_outer("props").alias("p", "v"))
    last = stored.unionByName(new).groupBy("label", "key", "p").agg(F.max(F.struct("seq", F.col("v").isNull().alias("gone"), "v")).alias("m"))
    live = F.when(F.col("p").isNotNull() & ~F.col("m.gone"), F.struct("p", F.col("m.v").alias("v")))
    seen = F.when(F.col("p").isNotNull(), F.struct("p", F.col("m.seq").alias("seq")))
    gather = lambda c: F.map_from_entries(F.array_sort(F.collect_list(c)))  # noqa: E731  a node's own properties
    return last.groupBy("label", "key").agg(gather(live).alias("props"), gather(seen).alias("seqs"))


def new_only(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose provenance isn't stored yet, repeated ones once."""
    return batch.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def entities_by_field(cells: DataFrame, field: str) -> DataFrame:
    """G15 a: values that share rows with an identity value form its entity; confidence by rows."""
    who = cells.filter(F.col("column") == field).select("dump_id", "row_index", F.col("canonical_key").alias("entity_id")).distinct()
    d = cells.select("dump_id", "row_index", "canonical_key").distinct().join(who, ["dump_id", "row_index"])
    d = d.groupBy("entity_id", "canonical_key").agg(F.count("*").alias("n"))
    rows = who.groupBy("entity_id").agg(F.count("*").alias("rows"))
    return d.join(rows, "entity_id").select("entity_id", "canonical_key", (F.col("n") / F.col("rows")).alias("confidence"))


def connected_entities(edges: DataFrame, src: str = "src_key", dst: str = "dst_key", max_iter: int = 40) -> DataFrame:
    """G15 b: entities are the components of pair edges, named by their smallest key."""
    c = connected_components(edges, src, dst, max_iter)
    return c.select(F.col("component").alias("entity_id"), F.col("vertex").alias("canonical_key"))


def flag_sensitive(names: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Fields with a rule other than passthrough are sensitive."""
    bad = [f for f, r in rules.items() if r != "passthrough"]
    return names.withColumn("sensitive", F.coalesce(F.col("name").isin(*bad), F.lit(False)))


def heavy_pairs(cells: DataFrame, k: int, tracked: int = 1024, most_tracked: int = 65_536) -> DataFrame:
    """The ``k`` most frequent pairs, counted exactly; of equal ones the first by their keys.

    A sketch of frequent items, merged from all tasks, names candidates: of ``n`` pairs in all, one that it doesn't track
    occurs ``3.5 * n / tracked`` times at most. Only candidates are counted, so no other pair is shuffled. If the ``k``-th of them isn't above that
    bound, four times as many are tracked; beyond ``most_tracked``, which bounds what is broadcast, all pairs are counted.
    """
    pairs = _pairs_in_rows(cells, None).select(F.col("a").alias("a_key"), F.col("b").alias("b_key"))
    counted = lambda d: d.groupBy("a_key", "b_key").agg(F.count("*").alias("count"))
    while tracked <= most_tracked:
        item = F.concat(F.length("a_key"), F.lit(":"), "a_key", "b_key")
        s = pairs.agg(F.count("*").alias("n"), F.call_function("approx_top_k", item, F.lit(tracked // 2), F.lit(tracked)).alias("top")).first()
        bound = 3.5 * s["n"] / tracked
        parts = [(int(x["item"].split(":", 1)[0]), x["item"].split(":", 1)[1]) for x in s["top"] or []]
        names = [(both[:n], both[n:]) for n, both in parts]
        some = cells.sparkSession.createDataFrame(names, "a_key string, b_key string")
        # of what is tracked but not named, none has more than the last name's estimate
        if len(names) == tracked // 2:
            bound = max(bound, s["top"][-1]["count"])
        best = cut(counted(pairs.join(F.broadcast(some), ["a_key", "b_key"])).orderBy(F.desc("count"), "a_key", "b_key").limit(k), "heavy-pairs")
        last = best.agg(F.count("*").alias("c"), F.min("count").alias("least")).first()
        if last["c"] == k and last["least"] > bound:
            return best
        tracked *= 4
    return counted(pairs).orderBy(F.desc("count"), "a_key", "b_key").limit(k)


def with_audit(df: DataFrame, actor: str, request_id: str, ts: Column) -> DataFrame:
    """Who wrote a row, for which request, when; none of them may be null."""
    if actor is None or request_id is None:
        raise ValueError("actor and request are needed")
    return df.withColumns({"written_by": F.lit(actor), "request_id": F.lit(request_id), "written_at": ts})
