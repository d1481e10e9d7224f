"""Replication of entity versions and its reconciliation.

A version is ``(entity_type, key, props, origin, timestamp, version, tombstone, seq)``; ``seq``
is the order of arrival, the smallest is the local side. All merges take any number of replicas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["entity_type", "key"]
#: Kinds of the properties of a sighting. A rule names its own.
SIGHTING_RULE = {"sum": ["count"], "min": ["first_seen"], "max": ["last_seen"], "newest": ["context"]}


def _props_hash() -> Column:
    entries = F.array_sort(F.map_entries("props"))
    return F.sha2(F.to_json(F.struct(entries.alias("e"))), 256)


def changelog(old: DataFrame, new: DataFrame, origin: str, ts: Column) -> DataFrame:
    """Entries ``(label, key, props, origin, timestamp, tombstone, change)`` from one state to the next."""
    a = old.select(F.col("label").alias("la"), F.col("key").alias("ka"), _props_hash().alias("ha"))
    b = new.select(F.col("label").alias("lb"), F.col("key").alias("kb"), "props", _props_hash().alias("hb"))
    d = a.join(b, (F.col("la") == F.col("lb")) & (F.col("ka") == F.col("kb")), "full_outer")
    change = F.when(F.col("ka").isNull(), "insert").when(F.col("kb").isNull(), "tombstone").when(F.col("ha") != F.col("hb"), "update")
    d = d.withColumn("change", change).filter("change is not null")
    return d.select(
        F.coalesce("la", "lb").alias("label"), F.coalesce("ka", "kb").alias("key"), "props", F.lit(origin).alias("origin"), ts.alias("timestamp"),
        (F.col("change") == "tombstone").alias("tombstone"), "change",
    )


def pull_since(entries: DataFrame, marks: DataFrame, peer: str) -> tuple[DataFrame, DataFrame]:
    """R2: a peer's entries strictly after its mark ``(timestamp, id)``, and all marks advanced."""
    mine = marks.filter(F.col("peer") == peer).select(F.struct("timestamp", "id").alias("mark"), F.lit(1).alias("_one"))
    d = entries.withColumn("_one", F.lit(1)).join(F.broadcast(mine), "_one", "left")  # one row
    d = d.filter(F.col("mark").isNull() | (F.struct("timestamp", "id") > F.col("mark"))).drop("_one", "mark")
    top = d.agg(F.max(F.struct("timestamp", "id")).alias("m")).filter("m is not null")
    new = top.select(F.lit(peer).alias("peer"), "m.timestamp", "m.id")
    both = marks.select("peer", "timestamp", "id").unionByName(new)
    return d, both.groupBy("peer").agg(F.max(F.struct("timestamp", "id")).alias("m")).select("peer", "m.timestamp", "m.id")


def _order(*first: str) -> Column:
    return F.struct(*first, "timestamp", "origin", "version", (-F.col("seq")).alias("s"))


def _pick(versions: DataFrame, order: Column) -> DataFrame:
    cols = [c for c in versions.columns if c not in KEYS]
    d = versions.groupBy(*KEYS).agg(F.max_by(F.struct(*cols), order).alias("v"))
    return d.select(*KEYS, *[f"v.{c}" for c in cols]).select(*versions.columns)


def merge_lww(versions: DataFrame) -> DataFrame:
    """The latest version by time, then origin; a tombstone beats any live version, the newer of two."""
    return _pick(versions, _order("tombstone"))


def merge_tombstone(versions: DataFrame) -> DataFrame:
    """Tombstones first, the newer of two; without any as R3, which is so already."""
    return merge_lww(versions)


def merge_sightings(versions: DataFrame, rule: dict[str, list[str]] = SIGHTING_RULE) -> DataFrame:
    """Sums, least and greatest values, the newest for listed fields, all else from the local side.

    A missing counter is 0; a value that is no integer doesn't count as a time. Of newest values with one
    time and origin the greatest counts, as in R9. The result carries
    the greatest version order; the local side is the smallest ``seq``. Tombstones have their own merge.
    """
    v = lambda f: F.col("props")[f]
    whole = lambda f: v(f).try_cast("long")
    aggs = [F.min_by("props", "seq").alias("_local"), F.max(F.struct("timestamp", "origin", "version")).alias("_top"), F.min("seq").alias("seq"), F.lit(False).alias("tombstone")]
    named = []
    for f in rule.get("sum", []):
        aggs.append(F.sum(F.coalesce(whole(f), F.lit(0))).cast("string").alias(f"_f_{f}"))
        named.append(f)
    for kind, fn in (("min", F.min), ("max", F.max)):
        for f in rule.get(kind, []):
            aggs.append(fn(whole(f)).cast("string").alias(f"_f_{f}"))
            named.append(f)
    for f in rule.get("newest", []):
        aggs.append(F.max_by(v(f), F.when(v(f).isNotNull(), F.struct("timestamp", "origin", v(f).alias("value")))).alias(f"_f_{f}"))
        named.append(f)
    d = versions.groupBy(*KEYS).agg(*aggs)
    rest = F.map_filter("_local", lambda k, _: ~k.isin(*named)) if named else F.col("_local")
    fresh = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"_f_{f}").alias("value")) for f in named]), lambda e: e["value"].isNotNull())
    props = F.map_concat(F.coalesce(rest, F.expr("map()").cast("map<string,string>")), F.map_from_entries(fresh))
    return d.select(*KEYS, props.alias("props"), "_top.origin", "_top.timestamp", "_top.version", "tombstone", "seq").select(*versions.columns)


def _by_rule(versions: DataFrame, rules: dict[str, str], default: str, sightings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each type by its strategy; keys with a tombstone under ``sighting`` are merged as tombstones."""
    kinds = set(rules.values()) | {default}
    d = versions.withColumn("_rule", _rule(rules, default))
    dead = d.filter(F.col("tombstone") & (F.col("_rule") == "sighting")).select(*KEYS).distinct()
    out = merge_lww(d.filter("_rule in ('last_writer_wins', 'tombstone')").drop("_rule"))
    if "sighting" in kinds:
        s = d.filter("_rule = 'sighting'").drop("_rule")
        out = out.unionByName(sightings(s.join(dead, KEYS, "left_anti").select(*versions.columns)))
        out = out.unionByName(merge_tombstone(s.join(dead, KEYS, "left_semi").select(*versions.columns)))
    return out


def _rule(rules: dict[str, str], default: str) -> Column:
    rule = F.lit(default)
    for t, r in rules.items():
        rule = F.when(F.col("entity_type") == t, r).otherwise(rule)
    return rule


def merge(versions: DataFrame, rules: dict[str, str], default: str = "last_writer_wins", sighting_rule: dict[str, list[str]] = SIGHTING_RULE) -> DataFrame:
    """Each type by its strategy: ``last_writer_wins``, ``sighting`` or ``tombstone``.

    Keys with a tombstone under ``sighting`` are merged as tombstones.
    """
    return _by_rule(versions, rules, default, lambda s: merge_sightings(s, sighting_rule))


def compare_vectors(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(key, relation)``: how each local version vector stands to the remote one; a missing origin is 0."""
    d = local.select("key", F.col("version_vector").alias("a")).join(remote.select("key", F.col("version_vector").alias("b")), "key")
    z = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    signs = F.map_values(F.map_zip_with("a", "b", lambda _, x, y: F.signum(z(x) - z(y))))
    up, down = F.exists(signs, lambda s: s > 0), F.exists(signs, lambda s: s < 0)
    relation = F.when(up & down, "concurrent").when(up, "after").when(down, "before").otherwise("equal")
    return d.select("key", relation.alias("relation"))


COUNTERS = "map<string,map<string,bigint>>"
STAMPS = "map<string,struct<timestamp:bigint,origin:string>>"


def _map_of(names: list[str], values: list[Column], kind: str) -> Column:
    """A map of the values that aren't null."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, values)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).cast(kind) if names else F.expr(f"cast(map() as {kind})")


def _with_totals(df: DataFrame, fields: list[str]) -> DataFrame:
    """``props`` with each counter as the sum over its origins."""
    total = lambda f: F.aggregate(F.map_values(F.col("counters")[f]), F.lit(0).cast("long"), lambda a, x: a + x)
    rest = F.map_filter("props", lambda k, _: ~k.isin(*fields)) if fields else F.col("props")
    sums = _map_of(fields, [F.coalesce(total(f), F.lit(0)).cast("string") for f in fields], "map<string,string>")
    return df.withColumn("props", F.map_concat(rest, sums))


def _merge_sighting_states(states: DataFrame, rule: dict[str, list[str]]) -> DataFrame:
    sums, newest = rule.get("sum", []), rule.get("newest", [])
    ends = [(f, fn) for kind, fn in (("min", F.min), ("max", F.max)) for f in rule.get(kind, [])]
    v = lambda f: F.col("props")[f]
    aggs = [
        F.min_by("props", F.struct("seq", "origin", "version")).alias("_local"), F.max(F.struct("timestamp", "origin", "version")).alias("_top"),
        F.min("seq").alias("seq"), F.lit(False).alias("tombstone"), F.collect_list("counters").alias("_each"),  # a row a replica
        *[fn(v(f).try_cast("long")).cast("string").alias(f"_e{i}") for i, (f, fn) in enumerate(ends)],
        *[F.max(F.when(F.col("stamps")[f].isNotNull(), F.struct(F.col("stamps")[f].alias("at"), v(f).alias("value")))).alias(f"_n{i}") for i, f in enumerate(newest)],
    ]
    d = states.groupBy(*KEYS).agg(*aggs)
    none = F.expr("cast(map() as map<string,bigint>)")
    higher = lambda a, b: F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.greatest(x, y))
    d = d.withColumn("counters", F.aggregate("_each", F.expr(f"cast(map() as {COUNTERS})"), lambda a, x: F.map_zip_with(a, x, lambda _, p, q: higher(p, q))))
    named = [f for f, _ in ends] + newest
    values = [F.col(f"_e{i}") for i in range(len(ends))] + [F.col(f"_n{i}")["value"] for i in range(len(newest))]
    rest = F.map_filter("_local", lambda k, _: ~k.isin(*named)) if named else F.col("_local")
    props = F.map_concat(F.coalesce(rest, F.expr("map()").cast("map<string,string>")), _map_of(named, values, "map<string,string>"))
    stamps = _map_of(newest, [F.col(f"_n{i}")["at"] for i in range(len(newest))], STAMPS)
    d = _with_totals(d.withColumn("props", props), sums)
    return d.withColumn("stamps", stamps).select(*KEYS, "props", "_top.origin", "_top.timestamp", "_top.version", "tombstone", "seq", "counters", "stamps").select(*states.columns)


def merge_states(states: DataFrame, rules: dict[str, str], default: str = "last_writer_wins", sighting_rule: dict[str, list[str]] = SIGHTING_RULE) -> DataFrame:
    """The state that holds what all given ones hold, in whatever order and however often each is given.

    A state has ``counters``, for each summed field what each origin has counted itself, and ``stamps``, the version that each
    newest field is from. An origin's count only grows, so the greatest is the latest and none is added twice.
    """
    return _by_rule(states, rules, default, lambda s: _merge_sighting_states(s, sighting_rule))


def replica_state(log: DataFrame, rules: dict[str, str], default: str = "last_writer_wins", sighting_rule: dict[str, list[str]] = SIGHTING_RULE) -> DataFrame:
    """The state of a replica from the versions that it has; of each origin all, or all up to some version.

    A counter of an origin is the sum over its own versions. An origin that is missing counts under an empty name.
    """
    sums, newest = sighting_rule.get("sum", []), sighting_rule.get("newest", [])
    at = F.struct(F.col("timestamp").cast("long").alias("timestamp"), F.col("origin").alias("origin"))
    own = [F.when(F.col("props")[f].isNotNull(), at) for f in newest]
    states = log.withColumns({"counters": F.expr(f"cast(map() as {COUNTERS})"), "stamps": _map_of(newest, own, STAMPS)})
    merged = merge_states(states, rules, default, sighting_rule)
    if not sums:
        return merged
    counted = log.filter((_rule(rules, default) == "sighting") & ~F.col("tombstone")).groupBy(*KEYS, F.coalesce("origin", F.lit("")).alias("_by"))
    counted = counted.agg(*[F.sum(F.coalesce(F.col("props")[f].try_cast("long"), F.lit(0))).alias(f"_s{i}") for i, f in enumerate(sums)])
    counted = counted.groupBy(*KEYS).agg(*[F.map_from_entries(F.collect_list(F.struct("_by", f"_s{i}"))).alias(f"_m{i}") for i in range(len(sums))])
    counted = counted.select(*KEYS, _map_of(sums, [F.col(f"_m{i}") for i in range(len(sums))], COUNTERS).alias("_own"))
    live = (_rule(rules, default) == "sighting") & ~F.col("tombstone")
    d = merged.join(counted, KEYS, "left").withColumn("counters", F.when(live & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("counters"))).drop("_own")
    return _with_totals(d.filter(live), sums).unionByName(d.filter(~live | live.isNull())).select(*merged.columns)


def reconcile(a: DataFrame, b: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The state that both replicas reach from their states; again with either, it stays as it is."""
    return merge_states(a.unionByName(b), rules)


def split_mergeable(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with type and key, and the others."""
    ok = F.col("entity_type").isNotNull() & F.col("key").isNotNull()
    return entries.filter(ok), entries.filter(~ok)


def copy_partition(src: DataFrame, dst: DataFrame, partition: str, origin: str, ts: Column) -> DataFrame:
    """``dst`` with the partition's rows of ``src``, stamped; of equal keys the stored row stays."""
    new = src.filter(F.col("partition_key") == partition).withColumns({"synced_from": F.lit(origin), "synced_at": ts})
    new = new.dropDuplicates(["key"]).join(dst.select("key"), "key", "left_anti").select(*dst.columns)
    return dst.unionByName(new)


def lag(entries: DataFrame, now: Column) -> DataFrame:
    """Entries and seconds since the last one, by origin."""
    return entries.groupBy("origin").agg(F.count("*").alias("n"), (now - F.max("timestamp")).alias("lag_s"))
