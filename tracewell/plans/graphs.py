"""Queries for building the graph, asking it, and enriching its values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.operators import enrich as E, graph as G, graph_queries as Q
from tracewell.plans.base import CELLS, SALT, cells, key_sql, query, stamp, table
from tracewell.sources import records as S

_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _ts(sql: str) -> str:
    return _T.format(sql)


@query("field_values", f"WITH {CELLS} SELECT k AS canonical_key, min(canonical) AS value, {_ts('min(ts)')} AS created_at FROM cells GROUP BY 1")
def field_values(spark, d):
    return G.field_values(cells(spark, d)).select("canonical_key", "value", stamp("created_at").alias("created_at"))


@query("fields", f"WITH {CELLS} SELECT DISTINCT col AS name FROM cells")
def fields(spark, d):
    return G.fields(cells(spark, d))


@query("value_of", f"WITH {CELLS} SELECT DISTINCT k AS canonical_key, col AS name FROM cells")
def value_of(spark, d):
    return G.value_of(cells(spark, d))


@query("dump_nodes", f"WITH {CELLS} SELECT dump_id, {_ts('min(ts)')} AS received_at FROM cells GROUP BY 1")
def dump_nodes(spark, d):
    return G.dump_nodes(cells(spark, d)).select("dump_id", stamp("received_at").alias("received_at"))


@query("rows_nodes", f"WITH {CELLS} SELECT dump_id, row_index, count(*) AS n_cells FROM cells GROUP BY 1, 2")
def rows_nodes(spark, d):
    return G.row_nodes(cells(spark, d))


@query("sightings", f"WITH {CELLS} SELECT sha256(dump_id || '|' || row_index || '|' || col || '|' || position) AS sighting_id, dump_id, row_index, raw, k AS canonical_key FROM cells")
def sightings(spark, d):
    return G.sightings(cells(spark, d)).select("sighting_id", "dump_id", "row_index", "raw", "canonical_key")


_HASHES = f"""{CELLS}, h AS (SELECT dump_id, row_index, sha256('{SALT}:v1:' || string_agg(k, '|' ORDER BY k)) AS row_hash FROM (SELECT DISTINCT dump_id, row_index, k FROM cells) GROUP BY 1, 2)"""


def _hashes(spark, d):
    return G.row_hashes(cells(spark, d), SALT)


#: Row hashes without the customer, so that rows repeat in and across dumps.
_COARSE = f"""{CELLS}, h AS (SELECT dump_id, row_index, sha256('{SALT}:v1:' || string_agg(k, '|' ORDER BY k)) AS row_hash FROM (SELECT DISTINCT dump_id, row_index, k FROM cells WHERE col <> 'customer'
  UNION SELECT dump_id, row_index, sha256('{SALT}:v1:customer:' || (CAST(raw AS BIGINT) % 50)) FROM cells WHERE col = 'customer') GROUP BY 1, 2)"""


def _coarse(spark, d):
    c = cells(spark, d).select("dump_id", "row_index", "column", "canonical_key", "raw", "ts")
    rough = F.sha2(F.concat(F.lit(f"{SALT}:v1:customer:"), F.expr("try_cast(raw as bigint)") % 50), 256)
    return G.row_hashes(c.withColumn("canonical_key", F.when(F.col("column") == "customer", rough).otherwise(F.col("canonical_key"))), SALT)


@query("row_hash", f"WITH {_HASHES} SELECT * FROM h")
def row_hash(spark, d):
    return _hashes(spark, d)


@query("row_hash_edges", f"WITH {_COARSE} SELECT DISTINCT dump_id, row_hash FROM h")
def row_hash_edges(spark, d):
    return G.dump_row_hashes(_coarse(spark, d))


_PAIRS = f"""{CELLS}, c AS (SELECT DISTINCT dump_id, row_index, k, ts FROM cells),
e AS (SELECT a.k AS a_key, b.k AS b_key, count(*) AS n, max(a.ts) AS t FROM c a JOIN c b ON a.dump_id = b.dump_id AND a.row_index = b.row_index AND a.k < b.k GROUP BY 1, 2)"""


def _shown(e):
    return e.select("a_key", "b_key", F.col("count").alias("n"), stamp("last_seen").alias("last_seen"))


@query("co_occurs", f"WITH {_PAIRS} SELECT a_key, b_key, n, {_ts('t')} AS last_seen FROM e")
def co_occurs(spark, d):
    return _shown(G.co_occurs(cells(spark, d)))


_LIMITED = f"""WITH {CELLS}, e AS (SELECT least(a.k, b.k) AS a_key, greatest(a.k, b.k) AS b_key, count(*) AS n, max(a.ts) AS t FROM cells a JOIN cells b ON a.dump_id = b.dump_id AND a.row_index = b.row_index
AND a.col = 'status' AND b.col = 'priority' GROUP BY 1, 2) SELECT a_key, b_key, n, {_ts('t')} AS last_seen FROM e"""


@query("co_occurs_limited", _LIMITED)
def co_occurs_limited(spark, d):
    return _shown(G.co_occurs(cells(spark, d), [("status", "priority")]))


@query("co_occurs_increment", f"WITH {_PAIRS} SELECT a_key, b_key, n, {_ts('t')} AS last_seen FROM e")
def co_occurs_increment(spark, d):
    c = cells(spark, d)
    old, new = (G.co_occurs(c.filter(f)) for f in ("row_index % 10 > 0", "row_index % 10 = 0"))
    return _shown(G.add_counts(old, new, ["a_key", "b_key"]))


@query("pair_edges", f"""WITH {CELLS} SELECT 'order' AS pair_type, a.k AS src_key, b.k AS dst_key, count(*) AS n, {_ts('max(a.ts)')} AS last_seen,
array_to_string(list(a.dump_id || ':' || lpad(CAST(a.row_index AS VARCHAR), 12, '0') ORDER BY a.dump_id || ':' || lpad(CAST(a.row_index AS VARCHAR), 12, '0'))[1:5], ',') AS samples FROM cells a JOIN cells b
ON a.dump_id = b.dump_id AND a.row_index = b.row_index AND a.col = 'customer' AND b.col = 'priority' GROUP BY 2, 3""")
def pair_edges(spark, d):
    e = G.pair_edges(cells(spark, d), [("order", "customer", "priority")])
    return e.select("pair_type", "src_key", "dst_key", F.col("count").alias("n"), stamp("last_seen").alias("last_seen"), F.array_join("samples", ",").alias("samples"))


@query("heavy_pairs", f"WITH {_PAIRS} SELECT a_key, b_key, n AS \"count\" FROM e ORDER BY n DESC, a_key, b_key LIMIT 10")
def heavy_pairs(spark, d):
    return G.heavy_pairs(cells(spark, d), 10)


def _jobs(spark, d):
    """Events as property jobs on their user; an error removes the property of its minute."""
    e = table(spark, d, "events")
    name = F.concat(F.lit("p"), F.col("event_id") % 4)
    v = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select(F.lit("User").alias("label"), F.col("user_id").cast("string").alias("key"), F.create_map(name, v).alias("props"), F.col("event_id").alias("seq"))


_NODES = """j AS (SELECT CAST(user_id AS VARCHAR) AS key, 'p' || (event_id % 4) AS p, event_type AS v, event_id FROM events),
l AS (SELECT key, p, arg_max(v, event_id) AS v FROM j GROUP BY 1, 2),
n AS (SELECT key, coalesce(string_agg(p || '=' || v, ',' ORDER BY p) FILTER (v <> 'error'), '') AS props FROM l GROUP BY 1)"""


def _nodes(spark, d):
    return G.upsert_props(spark.createDataFrame([], "label string, key string, props map<string,string>"), _jobs(spark, d))


def _flat(nodes):
    return nodes.select("label", "key", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("props"))


@query("upsert_props", f"WITH {_NODES} SELECT 'User' AS label, key, props FROM n")
def upsert(spark, d):
    return _flat(_nodes(spark, d))


@query("reingest_idempotent", f"WITH {CELLS} SELECT dump_id, row_index, position, raw FROM cells WHERE row_index % 4 = 0")
def reingest(spark, d):
    c = cells(spark, d)
    keys = ["dump_id", "row_index", "column", "position"]
    return G.new_only(c.unionByName(c), c.filter("row_index % 4 > 0"), keys).select("dump_id", "row_index", "position", "raw")


@query("entities", f"""WITH {CELLS}, w AS (SELECT DISTINCT dump_id, row_index, k AS entity_id FROM cells WHERE col = 'customer'),
n AS (SELECT entity_id, c.k AS canonical_key, count(*) AS n FROM (SELECT DISTINCT dump_id, row_index, k FROM cells) c JOIN w USING (dump_id, row_index) GROUP BY 1, 2),
r AS (SELECT entity_id, count(*) AS r FROM w GROUP BY 1) SELECT entity_id, canonical_key, round(n / r, 9) AS confidence FROM n JOIN r USING (entity_id)""")
def entities(spark, d):
    return G.entities_by_field(cells(spark, d), "customer").withColumn("confidence", F.round("confidence", 9))


@query("components", """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, concat_ws(':', 'p' || l_partkey, CAST(l_quantity AS INT), CAST(round(l_discount * 100) AS INT)) AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS v, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v)
SELECT min(c) AS entity_id, v AS canonical_key FROM r GROUP BY v""")
def components(spark, d):
    """Orders that share an offer (part, quantity and discount), over all lines."""
    offer = F.concat_ws(":", F.concat(F.lit("p"), "l_partkey"), F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"))
    return G.connected_entities(table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src_key"), offer.alias("dst_key")))


@query("sensitive_fields", f"WITH {CELLS} SELECT DISTINCT col AS name, col = 'customer' AS sensitive FROM cells")
def sensitive(spark, d):
    return G.flag_sensitive(G.fields(cells(spark, d)), {"customer": "hash", "status": "passthrough"})


@query("write_audit", f"WITH {CELLS} SELECT col AS name, 'loader' AS written_by, 'r1' AS request_id, {_ts('max(ts)')} AS written_at FROM cells GROUP BY 1")
def write_audit(spark, d):
    c = G.with_audit(cells(spark, d), "loader", "r1", F.col("ts"))
    return c.groupBy(F.col("column").alias("name"), "written_by", "request_id").agg(F.max("written_at").alias("w")).select("name", "written_by", "request_id", stamp("w").alias("written_at"))


@query("rebuild_dump", f"WITH {CELLS} SELECT row_index, string_agg(position || ':' || col || '=' || raw || '/' || canonical, ';' ORDER BY position) AS cells FROM cells WHERE dump_id = '1997-05' GROUP BY 1")
def rebuild_dump(spark, d):
    c = cells(spark, d)
    x = Q.rebuild_dump(G.row_nodes(c), G.sightings(c), G.field_values(c), "1997-05")
    one = lambda e: F.concat(e["position"].cast("string"), F.lit(":"), e["column"], F.lit("="), e["raw"], F.lit("/"), e["canonical"])
    return x.select("row_index", F.array_join(F.transform("cells", one), ";").alias("cells"))


@query("rebuild_wide", "SELECT o_orderkey AS row_index, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05'")
def rebuild_wide(spark, d):
    return Q.rebuild_wide(G.sightings(cells(spark, d)), "1997-05", ["status", "priority", "customer"])


_LOW = key_sql("'priority'", "'5-low'")


def _low():
    import hashlib

    return hashlib.sha256(f"{SALT}:v1:priority:5-low".encode()).hexdigest()


@query("neighbours", f"""WITH {_PAIRS} SELECT CASE WHEN a_key = {_LOW} THEN b_key ELSE a_key END AS key, n, {_ts('t')} AS last_seen FROM e WHERE {_LOW} IN (a_key, b_key) ORDER BY n DESC, key LIMIT 20""")
def neighbours(spark, d):
    x = Q.neighbours(G.co_occurs(cells(spark, d)), _low(), 20)
    return x.select("key", F.col("count").alias("n"), stamp("last_seen").alias("last_seen"))


@query("pair_variations", f"""WITH {CELLS}, p AS (SELECT a.k AS src_key, b.k AS dst_key, count(*) AS n FROM cells a JOIN cells b ON a.dump_id = b.dump_id AND a.row_index = b.row_index AND a.col = 'customer' AND b.col = 'priority' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY n DESC, dst_key) AS r FROM p)
SELECT src_key, count(*) AS variations, string_agg(dst_key || '=' || n, ',' ORDER BY r) FILTER (r <= 5) AS samples FROM r GROUP BY 1""")
def pair_variations(spark, d):
    x = Q.pair_variations(G.pair_edges(cells(spark, d), [("order", "customer", "priority")]))
    return x.select("src_key", "variations", F.array_join("samples", ",").alias("samples"))


@query("similar_dumps", f"WITH {_COARSE} SELECT dump_id, count(DISTINCT row_hash) AS matched_rows FROM h WHERE dump_id <> '1997-05' AND row_hash IN (SELECT row_hash FROM h WHERE dump_id = '1997-05') GROUP BY 1")
def similar(spark, d):
    return Q.similar_dumps(G.dump_row_hashes(_coarse(spark, d)), "1997-05")


@query("dump_coverage", f"""WITH {_COARSE}, s AS (SELECT dump_id, count(DISTINCT row_hash) AS n FROM h GROUP BY 1),
m AS (SELECT dump_id, count(DISTINCT row_hash) AS c FROM h WHERE dump_id <> '1997-05' AND row_hash IN (SELECT row_hash FROM h WHERE dump_id = '1997-05') GROUP BY 1)
SELECT dump_id, round(c / (SELECT n FROM s WHERE dump_id = '1997-05'), 9) AS coverage, c = n AND n = (SELECT n FROM s WHERE dump_id = '1997-05') AS is_exact FROM m JOIN s USING (dump_id)""")
def coverage(spark, d):
    return Q.coverage(G.dump_row_hashes(_coarse(spark, d)), "1997-05").withColumn("coverage", F.round("coverage", 9))


def _novelty_sql(items: str, col: str) -> str:
    return f"""r AS (SELECT dump_id, min(ts) AS received_at FROM cells GROUP BY 1), i AS (SELECT DISTINCT dump_id, {col} AS x FROM {items}),
f AS (SELECT x, arg_min(dump_id, (received_at, dump_id)) AS d FROM i JOIN r USING (dump_id) GROUP BY 1)
SELECT dump_id, round(avg(CAST(f.d = dump_id AS DOUBLE)), 9) AS novelty FROM i JOIN f USING (x) GROUP BY 1"""


@query("row_novelty", f"WITH {_COARSE}, {_novelty_sql('h', 'row_hash')}")
def row_novelty(spark, d):
    return Q.row_novelty(_coarse(spark, d), G.dump_nodes(cells(spark, d))).withColumn("novelty", F.round("novelty", 9))


@query("value_novelty", f"WITH {CELLS}, {_novelty_sql('cells', 'k')}")
def value_novelty(spark, d):
    c = cells(spark, d)
    return Q.value_novelty(c, G.dump_nodes(c)).withColumn("novelty", F.round("novelty", 9))


@query("point_lookup", f"WITH {_NODES} SELECT 'User' AS label, key, props FROM n WHERE key = '7'")
def lookup(spark, d):
    """In a stored table: nodes in 16 buckets by key, of which the lookup reads one."""
    stored = S.write_bucketed(_nodes(spark, d), f"nodes_{uuid.uuid4().hex}", "key", 16)
    return _flat(Q.lookup(stored, "User", "7"))


@query("filter_prop", f"WITH {_NODES} SELECT 'User' AS label, key, props FROM n WHERE contains(',' || props || ',', ',p1=view,')")
def filter_prop(spark, d):
    return _flat(Q.filter_by_prop(_nodes(spark, d), "User", "p1", "view"))


@query("count_labels", "SELECT 'User' AS label, count(DISTINCT user_id) AS n FROM events")
def count_labels(spark, d):
    return Q.count_by_label(_nodes(spark, d))


@query("duplicate_rows", f"WITH {_COARSE} SELECT row_hash, count(*) AS n, string_agg(DISTINCT dump_id, ',' ORDER BY dump_id) AS dumps FROM h GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, d):
    return Q.duplicate_rows(_coarse(spark, d)).select("row_hash", "n", F.array_join("dumps", ",").alias("dumps"))


@query("dump_overlap", f"""WITH {_COARSE}, x AS (SELECT DISTINCT dump_id, row_hash FROM h), s AS (SELECT dump_id, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.dump_id AS dump_a, b.dump_id AS dump_b, count(*) AS shared FROM x a JOIN x b ON a.row_hash = b.row_hash AND a.dump_id < b.dump_id GROUP BY 1, 2)
SELECT dump_a, dump_b, shared, round(shared / (a.n + b.n - shared), 9) AS jaccard FROM p JOIN s a ON a.dump_id = dump_a JOIN s b ON b.dump_id = dump_b""")
def overlap(spark, d):
    return Q.dump_overlap(G.dump_row_hashes(_coarse(spark, d))).withColumn("jaccard", F.round("jaccard", 9))


@query("provenance", f"WITH {CELLS} SELECT dump_id, row_index, raw, {_ts('ts')} AS ts FROM cells WHERE k = {_LOW}")
def provenance(spark, d):
    return Q.provenance(G.sightings(cells(spark, d)), _low()).select("dump_id", "row_index", "raw", stamp("ts").alias("ts"))


_IP = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
_VALUES = f"""v AS (SELECT DISTINCT m AS canonical, sha256(m) AS k FROM (SELECT unnest(regexp_extract_all(text, '{_IP}')) AS m FROM documents)),
o AS (SELECT *, CAST(split_part(canonical, '.', 1) AS INT) AS a, CAST(split_part(canonical, '.', 2) AS INT) AS b FROM v),
n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _values(spark, d):
    x = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("canonical")).distinct()
    return x.select(F.lit("ip").alias("field_type"), "canonical", F.sha2("canonical", 256).alias("canonical_key"))


def _places(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    octet = F.split_part("canonical", F.lit("."), F.lit(1)).cast("int")
    return _values(spark, d).join(n, F.pmod(octet, F.lit(40)) == F.col("n_nationkey")).select(F.col("canonical").alias("ip_address"), F.col("n_name").alias("country"), F.col("r_name").alias("city"))


@query("enrich_geo", f"WITH {_VALUES} SELECT 'geoip_' || canonical AS key, k AS canonical_key, canonical, n_name AS country, r_name AS city, 'geoip' AS source, '2024-01-01 00:00:00' AS enriched_at FROM o JOIN n ON n_nationkey = a % 40")
def geo(spark, d):
    x = E.enrich_geo(_values(spark, d), _places(spark, d), at=F.lit("2024-01-01").cast("timestamp"))
    return x.withColumn("enriched_at", stamp("enriched_at"))


@query("enrich_asn", f"WITH {_VALUES} SELECT 'asn_' || canonical AS key, k AS canonical_key, canonical, CAST(a * 256 + b AS BIGINT) AS asn, 'asn' AS source, '2024-01-01 00:00:00' AS enriched_at FROM o WHERE b % 2 = 0")
def asn(spark, d):
    p = F.split("canonical", "[.]")
    ref = _values(spark, d).filter(p[1].cast("int") % 2 == 0).select(F.col("canonical").alias("ip_address"), (p[0].cast("long") * 256 + p[1].cast("long")).alias("asn"))
    x = E.enrich_asn(_values(spark, d), ref, at=F.lit("2024-01-01").cast("timestamp"))
    return x.withColumn("enriched_at", stamp("enriched_at"))


_V6 = """six AS (SELECT k AS canonical_key, canonical FROM o WHERE a < 256 UNION ALL
  SELECT sha256('six:' || user_id), '2001:db8:' || lower(to_hex(user_id % 16)) || ':' || lower(to_hex(user_id)) || '::' || lower(to_hex(user_id % 7 + 1)) FROM (SELECT DISTINCT user_id FROM events))"""
_BITS = """CASE WHEN contains(canonical, '.') THEN '4' || array_to_string(list_transform(string_split(canonical, '.'), lambda x: right(bin(256 + CAST(x AS INT)), 8)), '')
  ELSE '6' || array_to_string(list_transform(list_concat(string_split(string_split(canonical, '::')[1], ':'), ['0', '0', '0', string_split(canonical, '::')[2]]), lambda x: right(bin(65536 + CAST('0x' || x AS INT)), 16)), '') END"""
_NETS = """nets AS (SELECT '4' || right(bin(256 + i), 8)[1:l] AS bits, (i - i % (1 << (8 - least(l, 8)))) || '.0.0.0/' || l AS network, l AS prefix_len FROM (SELECT CAST(unnest(range(256)) AS INT) AS i, 9 AS l)
    UNION ALL SELECT '4' || right(bin(256 + i * 16), 8)[1:4], i * 16 || '.0.0.0/4', 4 FROM (SELECT CAST(unnest(range(16)) AS INT) AS i)
    UNION ALL SELECT '6' || right(bin(65536 + 8193), 16) || right(bin(65536 + 3512), 16) || right(bin(65536 + i), 16)[1:12 + l], '2001:db8:' || lower(to_hex(i)) || '::/' || (44 + l), 44 + l
      FROM (SELECT CAST(unnest(range(0, 16, 2)) AS INT) AS i, 3 AS l UNION ALL SELECT CAST(unnest([1, 5, 6]) AS INT), 4)
    UNION ALL SELECT '6' || right(bin(65536 + 8193), 16) || right(bin(65536 + 3512), 16) || right(bin(65536 + u % 16), 16) || right(bin(65536 + u), 16) || repeat('0', 61) || right(bin(8 + u % 7 + 1), 3),
      '2001:db8:' || lower(to_hex(u % 16)) || ':' || lower(to_hex(u)) || '::' || lower(to_hex(u % 7 + 1)) || '/128', 128 FROM (SELECT CAST(unnest(range(0, 100, 9)) AS INT) AS u))"""


@query("enrich_cidr", f"""WITH {_VALUES}, {_V6}, {_NETS.replace("right(bin(256 + i), 8)[1:l]", "right(bin(256 + i), 8) || '0'")}, x AS (SELECT *, {_BITS} AS lead FROM six)
SELECT canonical_key, canonical, arg_max(network, prefix_len) AS network, max(prefix_len) AS prefix_len, NULL AS error FROM x JOIN nets ON starts_with(lead, bits) GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, network, -1, error FROM (VALUES ('10.1.0.0', 'invalid_network'), ('bad/x', 'invalid_network'), ('10.0.0.0/33', 'invalid_prefix'),
  ('::/129', 'invalid_prefix'), ('1:2:3/16', 'invalid_network'), ('10.0.0.0/', 'invalid_network'), ('300.1.1.1/8', 'invalid_network'), ('1::2::3/64', 'invalid_network')) AS e(network, error)""")
def cidr(spark, d):
    """Networks of both versions and many lengths, some of which can't be read, over the addresses of documents and one of version 6 a user."""
    net = lambda df, e: df.select(F.expr(e).alias("network"))
    four = net(spark.range(256), "id || '.0.0.0/9'").unionByName(net(spark.range(16), "id * 16 || '.0.0.0/4'"))
    six = net(spark.range(0, 16, 2), "'2001:db8:' || lower(hex(id)) || '::/47'").unionByName(net(spark.range(16).filter("id in (1, 5, 6)"), "'2001:DB8:' || hex(id) || '::/48'"))
    one = net(spark.range(0, 100, 9), "'2001:db8:' || lower(hex(id % 16)) || ':' || lower(hex(id)) || '::' || (id % 7 + 1) || '/128'")
    bad = net(spark.range(1), "explode(array('10.1.0.0', 'bad/x', '10.0.0.0/33', '::/129', '1:2:3/16', '10.0.0.0/', '300.1.1.1/8', '1::2::3/64'))")
    networks = four.unionByName(six).unionByName(one).unionByName(bad)
    u = table(spark, d, "events").select("user_id").distinct()
    v6 = u.select(
        F.sha2(F.concat(F.lit("six:"), "user_id"), 256).alias("canonical_key"),
        F.expr("'2001:db8:' || lower(hex(user_id % 16)) || ':' || lower(hex(user_id)) || '::' || (user_id % 7 + 1)").alias("canonical"), F.lit("ip").alias("field_type"),
    )
    values = _values(spark, d).select("canonical_key", "canonical", "field_type").unionByName(v6)
    found = E.enrich_cidr(values, networks).select("canonical_key", "canonical", F.lower("network").alias("network"), "prefix_len", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return found.unionByName(E.split_networks(networks)[1].select(none.alias("canonical_key"), none.alias("canonical"), "network", F.lit(-1).alias("prefix_len"), "error"))


_HOST = "lower(regexp_extract(url, 'https?://([^/?#]+)', 1))"


@query("enrich_chain", f"""WITH h AS (SELECT DISTINCT {_HOST} AS domain, length({_HOST}) % 40 AS n FROM pages), r AS (SELECT domain, n, '10.0.0.' || n AS ip FROM h UNION ALL SELECT domain, NULL, '10.0.1.' || n FROM h)
SELECT domain, ip, 'dns:' || domain AS discovered_via, n_name AS country FROM r LEFT JOIN nation ON n_nationkey = n""")
def chain(spark, d):
    h = table(spark, d, "pages").select(F.lower(F.regexp_extract("url", "https?://([^/?#]+)", 1)).alias("domain")).distinct()
    n = (F.length("domain") % 40).cast("string")
    dns = h.select("domain", F.array(F.concat(F.lit("10.0.0."), n), F.concat(F.lit("10.0.1."), n)).alias("resolved_ips"))
    places = table(spark, d, "nation").select(F.concat(F.lit("10.0.0."), F.col("n_nationkey")).alias("ip_address"), F.col("n_name").alias("country"))
    return E.enrich_domains(h.select(F.col("domain").alias("canonical")), dns, places)


@query("enrich_pending", f"WITH {_VALUES} SELECT k AS canonical_key, canonical FROM o WHERE b % 2 = 1 OR a % 40 NOT IN (SELECT n_nationkey FROM nation)")
def pending(spark, d):
    """Values that the geo table of the even second octets hasn't enriched yet, by its own result."""
    v = _values(spark, d)
    done = E.enrich_geo(v, _places(spark, d).filter(F.split_part("ip_address", F.lit("."), F.lit(2)).cast("int") % 2 == 0), source="geo")
    return E.pending(v, done, "geo")


@query("blocklist", f"WITH {_VALUES} SELECT canonical, a < 100 AS listed FROM o")
def blocklist(spark, d):
    v = _values(spark, d)
    bad = v.filter(F.split_part("canonical", F.lit("."), F.lit(1)).cast("int") < 100).select("canonical")
    return E.flag_blocklist(v, bad).select("canonical", "listed")
