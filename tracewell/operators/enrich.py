"""Enrichment of values from reference tables (E1-E6). Spark sizes the broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _enrich(values: DataFrame, ref: DataFrame, on: str, prefix: str, source: str, at: Column | None) -> DataFrame:
    """Rows ``(key, canonical_key, canonical, attributes, source, enriched_at)`` for the values that ``ref`` knows."""
    known = values.filter("field_type = 'ip'").select("canonical_key", "canonical").distinct()
    attrs = [c for c in ref.columns if c != on]
    d = known.join(ref.dropDuplicates([on]), F.col("canonical") == F.col(on))
    when = (at if at is not None else F.current_timestamp()).alias("enriched_at")
    return d.select(F.concat(F.lit(prefix), "canonical").alias("key"), "canonical_key", "canonical", *attrs, F.lit(source).alias("source"), when)


def enrich_geo(values: DataFrame, geo: DataFrame, source: str = "geoip", at: Column | None = None) -> DataFrame:
    """Places of addresses, keyed ``geoip_<ip>``, with source and time (by default that of the run)."""
    return _enrich(values, geo, "ip_address", "geoip_", source, at)


def enrich_asn(values: DataFrame, asn: DataFrame, source: str = "asn", at: Column | None = None) -> DataFrame:
    """Networks of addresses, keyed ``asn_<ip>``, with source and time (by default that of the run)."""
    return _enrich(values, asn, "ip_address", "asn_", source, at)


_OCTETS = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
_GROUPS = r"^[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*$"


def v4_number(c: Column) -> Column:
    p = F.transform(F.split(c, "[.]"), lambda x: x.try_cast("long"))
    return F.when(c.rlike(_OCTETS), p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3])


def v6_halves(c: Column) -> Column:
    """An address of version 6 as ``(hi, lo)``, its bits as two longs; null where it is none. A dotted tail counts as two groups."""
    dotted = F.regexp_extract(c, "([^:]*[.][^:]*)$", 1)
    number = v4_number(dotted)
    tail = F.concat(F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(65535))))
    plain = F.when(dotted == "", c).otherwise(F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(dotted)), tail))

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).when(x.rlike(_GROUPS), F.split(x, ":"))

    def halves(x: Column) -> Column:
        sides = F.split(x, "::", -1)
        left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
        n = F.size(left) + F.size(right)
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        every = F.when(F.size(sides) == 1, F.when(F.size(left) == 8, left)).when((F.size(sides) == 2) & (n < 8), F.concat(left, gap, right))
        half = lambda e, a: F.aggregate(F.slice(e, a, 4), F.lit(0).cast("long"), lambda t, g: F.shiftleft(t, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))
        return F.transform(F.array(every), lambda e: F.when(e.isNotNull(), F.struct(half(e, 1).alias("hi"), half(e, 5).alias("lo"))))[0]

    return F.transform(F.array(plain), halves)[0]


def address_bits(c: Column) -> Column:
    """``(bits, hi, lo)``: 32 or 128 bits, left-aligned in two longs; null where it is no address."""
    four, six = v4_number(c), v6_halves(c)
    return F.when(four.isNotNull(), F.struct(F.lit(32).alias("bits"), F.shiftleft(four, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))).when(
        six.isNotNull(), F.struct(F.lit(128).alias("bits"), six["hi"].alias("hi"), six["lo"].alias("lo"))
    )


def _lead(hi: Column, lo: Column, n: Column) -> tuple[Column, Column]:
    """The first ``n`` of 128 bits, the others 0."""
    upper = F.when(n <= 0, F.lit(0)).when(n >= 64, hi).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", hi, 64 - n), 64 - n))
    lower = F.when(n <= 64, F.lit(0)).when(n >= 128, lo).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", lo, 128 - n), 128 - n))
    return upper.cast("long"), lower.cast("long")


def split_networks(networks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Networks ``address/length`` of either version, with ``prefix_len`` and their leading bits; and the others, with an ``error``."""
    part = lambda i: F.split_part("network", F.lit("/"), F.lit(i))
    d = networks.withColumns({"_a": F.explode(F.array(address_bits(part(1)))), "prefix_len": F.when(part(2).rlike("^[0-9]{1,3}$"), part(2)).try_cast("int")})
    whole = F.col("network").rlike("^[^/]+/[^/]+$")
    error = F.when(F.col("_a").isNull() | ~whole, "invalid_network").when(F.col("prefix_len").isNull() | (F.col("prefix_len") > F.col("_a.bits")), "invalid_prefix")
    d = d.withColumn("error", F.when(F.col("network").isNull(), "invalid_network").otherwise(error))
    hi, lo = _lead(F.col("_a.hi"), F.col("_a.lo"), F.col("prefix_len"))
    good = d.filter("error is null").withColumns({"bits": F.col("_a.bits"), "hi": hi, "lo": lo}).drop("_a", "error")
    return good, d.filter("error is not null").select(*networks.columns, "error")


def enrich_cidr(values: DataFrame, networks: DataFrame) -> DataFrame:
    """The longest network ``(network, attributes)`` of its version that holds each address.

    An equi-join on prefix length and the leading bits, for the lengths that ``networks`` has; there are at most 33
    of version 4 and 129 of version 6. No range join. Networks and addresses that can't be read match nothing
    (:func:`split_networks` tells which networks those are); of equal networks the greatest by text, then attributes, counts.
    """
    n = split_networks(networks)[0]
    lengths: dict[int, list[int]] = {32: [], 128: []}
    for r in n.select("bits", "prefix_len").distinct().collect():  # 162 at most
        lengths[r["bits"]].append(r["prefix_len"])
    v = values.filter("field_type = 'ip'").select("canonical_key", "canonical").distinct()
    v = v.withColumn("_a", F.explode(F.array(address_bits(F.col("canonical"))))).filter("_a is not null")
    tried = lambda b: F.array(*[F.lit(x) for x in sorted(lengths[b])]).cast("array<int>")
    v = v.select("canonical_key", "canonical", "_a.*", F.explode(F.when(F.col("_a.bits") == 32, tried(32)).otherwise(tried(128))).alias("prefix_len"))
    hi, lo = _lead(F.col("hi"), F.col("lo"), F.col("prefix_len"))
    d = v.withColumns({"hi": hi, "lo": lo}).join(n, ["bits", "prefix_len", "hi", "lo"])
    attrs = [c for c in networks.columns if c != "network"]
    best = d.groupBy("canonical_key", "canonical").agg(F.max(F.struct("prefix_len", "network", *attrs)).alias("b"))
    return best.select("canonical_key", "canonical", "b.network", "b.prefix_len", *[f"b.{a}" for a in attrs])


def enrich_domains(domains: DataFrame, dns: DataFrame, geo: DataFrame) -> DataFrame:
    """Addresses that domains resolve to, and their places where known."""
    d = domains.select("canonical").distinct().join(dns, F.col("canonical") == F.col("domain"))
    d = d.select("domain", F.explode("resolved_ips").alias("ip")).distinct()
    attrs = [c for c in geo.columns if c != "ip_address"]
    d = d.join(geo.dropDuplicates(["ip_address"]), F.col("ip") == F.col("ip_address"), "left")
    return d.select("domain", "ip", F.concat(F.lit("dns:"), "domain").alias("discovered_via"), *attrs)


def pending(values: DataFrame, done: DataFrame, source: str) -> DataFrame:
    """E5: values that this source hasn't enriched yet."""
    had = done.filter(F.col("source") == source).select("canonical_key").distinct()
    return values.select("canonical_key", "canonical").distinct().join(had, "canonical_key", "left_anti")


def flag_blocklist(values: DataFrame, blocklist: DataFrame) -> DataFrame:
    """``listed`` for values whose canonical form is on the list."""
    b = blocklist.select(F.col("canonical").alias("_b")).distinct()
    return values.join(b, F.col("canonical") == F.col("_b"), "left").withColumn("listed", F.col("_b").isNotNull()).drop("_b")
