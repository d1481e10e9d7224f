"""Canonical forms of observed values, as column expressions over a whole table.

Each job adds ``canonical`` and, where a value isn't of its kind, an ``error``; nothing
is dropped. Python runs only for what Spark has no expression for (the text form
of version 6 addresses, international domain names), on Arrow batches. Rows that need it
are split off by a filter, so all others stay in the JVM; for that the input is read twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracewell.scratch import cut

VERSION = 1
#: Digest lengths in hexadecimal digits. Fixed values.
ALGORITHMS = {32: "md5", 40: "sha1", 64: "sha256", 96: "sha384", 128: "sha512"}
#: Timestamp patterns in the order in which they are tried. Fixed values.
PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def trimmed(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def light(kind: Column, raw: Column) -> Column:
    """The light canonical form by field type."""
    low = F.lower(trimmed(raw))
    return (
        F.when(kind == "domain", F.regexp_replace(low, r"\.$", ""))
        .when(kind == "ip", trimmed(raw))
        .when(kind == "hash", F.regexp_replace(F.lower(raw), r"(?U)^[\W_]+|[\W_]+$", ""))
        .otherwise(low)
    )


def canonicalise_light(df: DataFrame, type_col: str = "field_type", raw_col: str = "raw") -> DataFrame:
    """Light canonical form; the type itself compares trimmed and in lower case."""
    # once for each row, not once for each branch
    once = F.transform(F.array(F.lower(trimmed(F.col(type_col)))), lambda kind: light(kind, F.col(raw_col)))
    return df.withColumn("canonical", once[0])


@F.pandas_udf(T.StringType())
def _v6(s: pd.Series) -> pd.Series:
    import ipaddress

    def one(x):
        try:
            return None if x is None or "%" in x else str(ipaddress.IPv6Address(x))
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def _ascii_domain(s: pd.Series) -> pd.Series:
    import idna

    def one(x):
        try:
            return idna.encode(x, uts46=True).decode() if x else None
        except idna.IDNAError:
            return None

    return s.map(one)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, evaluated once for each row: Spark neither merges a generator with what uses
    its columns nor moves a filter on them below it, which would repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _by_rows(df: DataFrame, needs: Column, form) -> DataFrame:
    """``form(rows, python)`` of the rows that need Python, and of the others."""
    needs = F.coalesce(needs, F.lit(False))
    return form(df.filter(~needs), False).unionByName(form(df.filter(needs), True))


def _ip_form(t: str, python: bool) -> Column:
    """Of a trimmed column: host, prefix and their canonical form."""
    host = F.substring_index(t, "/", 1)
    v4 = host.rlike(rf"^{OCTET}([.]{OCTET}){{3}}$")
    base = F.when(v4, host)
    if python:
        base = F.coalesce(base, _v6(host))
    bits = F.regexp_extract(t, "^[^/]*/([0-9]{1,3})$", 1).try_cast("int")
    net = F.when(bits <= F.when(v4, 32).otherwise(128), F.concat(base, F.lit("/"), bits.cast("string")))
    return F.when(F.col(t).contains("/"), net).otherwise(base)


def canonicalise_ip(df: DataFrame, col: str) -> DataFrame:
    """Addresses and networks of both versions; host bits stay, zone names are refused."""
    d = once(df, _t=trimmed(F.col(col)))
    d = _by_rows(d, F.col("_t").contains(":"), lambda rows, python: rows.withColumn("canonical", _ip_form("_t", python)))
    return _finish(d.withColumn("is_cidr", F.col("canonical").contains("/") & F.col("canonical").isNotNull()), "invalid_ip").drop("_t")


PLAIN = r"^[\x00-\x7F]*$"


def _name_form(c: Column, python: bool) -> Column:
    """Without a final dot, ASCII and lower case, of trimmed text; null if nothing is left."""
    t = F.regexp_replace(c, r"\.$", "")
    return F.nullif(_ascii_domain(t) if python else F.lower(t), F.lit(""))


def _finish(df: DataFrame, error: str) -> DataFrame:
    bad = F.col("canonical").isNull()
    return df.withColumns({"version": F.lit(VERSION), "error": F.when(bad, F.lit(error))})


def canonicalise_domain(df: DataFrame, col: str) -> DataFrame:
    """Domain names; international ones by UTS 46, which refuses some that older rules take."""
    d = once(df, _t=trimmed(F.col(col)))
    d = _by_rows(d, ~F.col("_t").rlike(PLAIN), lambda rows, python: rows.withColumn("canonical", _name_form(F.col("_t"), python)))
    return _finish(d, "invalid_domain").drop("_t")


def _hash_form(c: Column) -> Column:
    """Of trimmed text."""
    t = F.lower(c)
    return F.when(t.rlike("^[0-9a-f]+$") & F.length(t).isin(*ALGORITHMS), t)


def canonicalise_hash(df: DataFrame, col: str) -> DataFrame:
    """Hexadecimal digests, with their algorithm by length."""
    d = df.withColumn("canonical", _hash_form(trimmed(F.col(col))))
    names = F.create_map(*[F.lit(x) for kv in ALGORITHMS.items() for x in kv])
    return _finish(d.withColumn("algorithm", names[F.length("canonical")]), "invalid_hash")


def _email_form(local: Column, name: Column) -> Column:
    return F.when(local != "", F.concat(local, F.lit("@"), name))


LOCAL, NAME = r"^(.*)@[^@]*$", r"@([^@]*)$"


def canonicalise_email(df: DataFrame, col: str) -> DataFrame:
    """Split at the last ``@``; the local part keeps its case, the domain follows N3."""
    d = once(df, _t=trimmed(F.col(col)))
    d = once(d, _local=F.regexp_extract("_t", LOCAL, 1), _name=trimmed(F.regexp_extract("_t", NAME, 1))).drop("_t")
    form = lambda rows, python: rows.withColumn("canonical", _email_form(F.col("_local"), _name_form(F.col("_name"), python)))
    return _finish(_by_rows(d, ~F.col("_name").rlike(PLAIN), form), "invalid_email").drop("_local", "_name")


def _timestamp_form(t: Column) -> Column:
    """Of trimmed text. Forms without a zone are read as UTC and the result is UTC, whatever the time zone of the session."""
    stamp = F.coalesce(
        F.when(t.rlike(RFC3339), F.try_to_timestamp(F.upper(t))),
        F.when(t.rlike("^[+-]?[0-9]{1,12}$"), F.timestamp_seconds(t.try_cast("long"))),
        *[F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(f"{p} Z")) for p in PATTERNS],
    )
    # a time without zone, from the epoch on, so that no step reads or shows session time
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(stamp))
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def canonicalise_timestamp(df: DataFrame, col: str) -> DataFrame:
    """ISO-8601 in UTC, whole seconds; digits alone are epoch seconds, day comes before month."""
    return _finish(df.withColumn("canonical", _timestamp_form(trimmed(F.col(col)))), "invalid_timestamp")


def key_of(kind: Column, canonical: Column, salt: str, version: int = VERSION) -> Column:
    return F.when(canonical.isNotNull(), F.sha2(F.concat_ws(":", F.lit(salt), F.lit(f"v{version}"), kind, canonical), 256))


def with_canonical_key(df: DataFrame, type_col: str, canonical_col: str, salt: str, version: int = VERSION) -> DataFrame:
    """Salted, versioned SHA-256 key; null for a null value."""
    return df.withColumn("canonical_key", key_of(F.col(type_col), F.col(canonical_col), salt, version))


def normalise(df: DataFrame, type_col: str, raw_col: str, salt: str) -> DataFrame:
    """The typed canonical form of a mixed table, with key, version and error class."""
    d = once(df, _k=F.lower(trimmed(F.col(type_col))), _t=trimmed(F.col(raw_col)))
    kind, mail = F.col("_k"), F.col("_k") == "email"
    d = once(d, _name=F.when(kind == "domain", F.col("_t")).when(mail, trimmed(F.regexp_extract("_t", NAME, 1))))
    needs = ((kind == "ip") & F.col("_t").contains(":")) | ~F.col("_name").rlike(PLAIN)

    def form(rows: DataFrame, python: bool) -> DataFrame:
        name = _name_form(F.col("_name"), python)
        if python:  # asked for once: Spark runs a Python function for all rows, whatever the branch
            rows = rows.withColumn("_name", name)
            name = F.col("_name")
        out = (
            F.when(kind == "ip", _ip_form("_t", python))
            .when(kind == "domain", name)
            .when(kind == "hash", _hash_form(F.col("_t")))
            .when(mail, _email_form(F.regexp_extract("_t", LOCAL, 1), name))
            .when(kind == "timestamp", _timestamp_form(F.col("_t")))
            .otherwise(F.lower("_t"))
        )
        return rows.withColumn("canonical", F.nullif(out, F.lit("")))

    d = once(_by_rows(d, needs, form).withColumnRenamed("canonical", "_c"), canonical=F.col("_c")).drop("_c")
    known = kind.isin("ip", "domain", "hash", "email", "timestamp")
    error = F.when(F.col("_t").isNull() | (F.col("_t") == ""), F.lit("empty")).otherwise(
        F.when(known, F.concat(F.lit("invalid_"), kind)).otherwise("unusable")
    )
    d = d.withColumn("error", F.when(F.col("canonical").isNull(), error)).withColumn("version", F.lit(VERSION))
    return d.withColumn("canonical_key", key_of(kind, F.col("canonical"), salt)).drop("_k", "_t", "_name")


def label_form(c: Column) -> Column:
    """A label keeps ASCII letters, digits and ``_``; the default is ``FieldValue``."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_]", "")
    return F.when(kept == "", "FieldValue").otherwise(kept)


def property_form(c: Column) -> Column:
    """A property name has ``_`` for every other character; the default is ``prop``."""
    kept = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(kept == "", "prop").otherwise(kept)


def sanitise_names(df: DataFrame, label_col: str, props_col: str) -> DataFrame:
    """Safe labels and property names; where two names become one, the later entry wins."""
    entries = F.transform(F.map_entries(props_col), lambda e: F.struct(property_form(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"])
    )
    return df.withColumns({label_col: label_form(F.col(label_col)), props_col: F.map_from_entries(last)})


def dedupe_in_dump(df: DataFrame) -> DataFrame:
    """One row for each dump and canonical key, the first by raw value."""
    others = [c for c in df.columns if c not in ("dump_id", "canonical_key")]
    row = F.min(F.struct(*(["raw"] if "raw" in others else []), *[c for c in others if c != "raw"])).alias("_r")
    return df.groupBy("dump_id", "canonical_key").agg(row).select("dump_id", "canonical_key", *[f"_r.{c}" for c in others]).select(*df.columns)


@dataclass
class Keyed:
    """A table whose ``keys`` are canonical keys.

    ``undirected`` says that its two keys stand in order. ``combine`` names the aggregate of each column that isn't part of
    a row's identity (``sum``, ``min``, ``max``): rows that become one under new keys are combined by it. None leaves rows as they are.
    """

    df: DataFrame
    keys: list[str]
    undirected: bool = False
    combine: dict[str, str] | None = None


def key_aliases(values: DataFrame, old: tuple[str, int], new: tuple[str, int]) -> DataFrame:
    """``(key, current_key)`` for the old and the new key of each ``(field_type, canonical)``; a value is hashed once, however often it was seen."""
    kind, c = F.col("field_type"), F.col("canonical")
    pairs = values.select("field_type", "canonical").dropna().distinct().select(key_of(kind, c, *old).alias("old"), key_of(kind, c, *new).alias("new"))
    return pairs.select(F.explode(F.array("old", "new")).alias("key"), F.col("new").alias("current_key")).distinct()


def current_keys(df: DataFrame, keys: list[str], aliases: DataFrame, known: str | None = None) -> DataFrame:
    """``df`` with each of ``keys`` replaced by its current form; one without an alias stays. ``known`` names a column that says whether all had one."""
    of, ok = aliases.select(F.col("key").alias("_key"), F.col("current_key").alias("_new")), F.lit(True)
    for k in keys:
        df = df.join(of, df[k] == F.col("_key"), "left").withColumns({k: F.coalesce("_new", k), f"_ok_{k}": F.col("_new").isNotNull()}).drop("_key", "_new")
        ok = ok & F.col(f"_ok_{k}")
    return (df.withColumn(known, ok) if known else df).drop(*[f"_ok_{k}" for k in keys])


def migrate_keys(values: DataFrame, tables: dict[str, Keyed | tuple[DataFrame, list[str]]], old: tuple[str, int], new: tuple[str, int]) -> dict[str, DataFrame]:
    """``tables`` with keys of the new salt and version.

    ``values`` has ``field_type`` and ``canonical``. One table of aliases, written once, serves all of them, an equi-join a key
    column. Rows under old and new keys may stand side by side, as they do while writers change over: undirected pairs are put in
    order again, and rows that become one are combined. A row tells by ``key_version`` whether all its keys were known.
    """
    aliases = cut(key_aliases(values, old, new), "key-aliases")
    out = {}
    for name, t in tables.items():
        t = t if isinstance(t, Keyed) else Keyed(*t)
        d = current_keys(t.df, t.keys, aliases, "_known")
        if t.undirected:
            a, b = t.keys
            d = d.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
        d = d.withColumn("key_version", F.when(F.col("_known"), new[1]).otherwise(old[1])).drop("_known")
        if t.combine is not None:
            same = [c for c in d.columns if c not in t.combine]
            aggregates = [getattr(F, how)(c).alias(c) for c, how in t.combine.items()]
            d = d.groupBy(*same).agg(*aggregates).select(*d.columns) if aggregates else d.distinct()
        out[name] = d
    return out
