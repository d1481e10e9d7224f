"""Queries for the privacy jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import privacy as P
from tracewell.plans.base import cells, query, table
from tracewell.scratch import cut

KEY, OTHER = b"\x42" * 32, b"\x43" * 32
RULES = {"c_name": "hash", "c_acctbal": "scrub", "c_mktsegment": "passthrough"}
_LONG = """
l AS (SELECT c_custkey, 'c_name' AS field, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_nationkey AS VARCHAR) FROM customer
      UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer)
"""
_PROTECTED = f"""{_LONG}, p AS (SELECT c_custkey, field, v, CASE field WHEN 'c_name' THEN 'sha256:' || sha256(v) WHEN 'c_acctbal' THEN '[REDACTED]' ELSE v END AS protected FROM l)"""


def _long(spark, d):
    e = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("v")) for f, c in (("c_name", "c_name"), ("c_acctbal", "c_nationkey"), ("c_mktsegment", "c_mktsegment"))])
    return table(spark, d, "customer").select("c_custkey", F.inline(e))


def _protected(spark, d):
    return P.apply_policy(_long(spark, d), "field", "v", RULES)


def _sealed(spark, d):
    """Customer names as envelopes, every fifth under another key, written once."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("v"))
    a = P.encrypt_values(c.filter("c_custkey % 5 > 0"), "v", KEY, "k1")
    return cut(a.unionByName(P.encrypt_values(c.filter("c_custkey % 5 = 0"), "v", OTHER, "k0")), "sealed")


@query("pii_policy", f"WITH {_PROTECTED} SELECT c_custkey, field, protected FROM p")
def policy(spark, d):
    return _protected(spark, d).select("c_custkey", "field", "protected")


@query("pii_hash", "SELECT c_custkey, 'sha256:' || sha256(c_name) AS hashed FROM customer")
def hashes(spark, d):
    return P.hash_values(table(spark, d, "customer"), "c_name").select("c_custkey", "hashed")


@query("pii_encrypt_roundtrip", "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS plain, length(c_name) + 16 AS sealed_bytes FROM customer")
def roundtrip(spark, d):
    plain, _ = P.decrypt_values(_sealed(spark, d), "envelope", {"k1": KEY}, "a", "r", "c_name")
    size = F.octet_length(F.unbase64(F.get_json_object("envelope", "$.ciphertext"))).cast("long")
    return plain.select("c_custkey", "plain", size.alias("sealed_bytes"))


@query("decrypt_audit", """SELECT 'auditor' AS actor, 'case 7' AS reason, 'c_name' AS field_name, CASE WHEN c_custkey % 5 > 0 THEN 'k1' ELSE 'k0' END AS key_id,
CASE WHEN c_custkey % 5 > 0 THEN 'ok' ELSE 'refused' END AS status, count(*) AS n FROM customer GROUP BY ALL""")
def audit(spark, d):
    _, a = P.decrypt_values(_sealed(spark, d), "envelope", {"k1": KEY, "k0": KEY}, "auditor", "case 7", "c_name")
    return a.groupBy("actor", "reason", "field_name", "key_id", "status").agg(F.count("*").alias("n"))


@query("pii_state", f"""WITH {_PROTECTED} SELECT field, CASE field WHEN 'c_name' THEN 'hashed' WHEN 'c_acctbal' THEN 'redacted' ELSE 'plain' END AS state, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT 'sealed', 'encrypted', count(*) FROM customer""")
def state(spark, d):
    a = _protected(spark, d).select("field", "protected").unionByName(_sealed(spark, d).select(F.lit("sealed").alias("field"), F.col("envelope").alias("protected")))
    return P.protection_state(a, "protected").groupBy("field", "state").agg(F.count("*").alias("n"))


@query("pii_sweep", """SELECT 'c_name' AS path, 'c_name' AS field, 'hashed' AS expected, 'plain' AS state, count(*) AS n FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'doc.inner.c_name', 'c_name', 'hashed', 'plain', count(*) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'doc.inner.c_acctbal', 'c_acctbal', 'redacted', 'hashed', count(*) FROM customer
UNION ALL SELECT 'doc.inner.a.b.0.c.d.c_name', 'c_name', 'hashed', 'plain', count(*) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'doc.inner.seal', 'seal', 'encrypted', 'plain', count(*) FROM customer""")
def sweep(spark, d):
    """Plain text as a column, in JSON and seven levels deep; a hash where redaction is due; an envelope of another algorithm."""
    hashed = F.concat(F.lit("sha256:"), F.sha2("c_name", 256))
    deep = F.struct(F.array(F.struct(F.struct(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(hashed).alias("c_name")).alias("d")).alias("c"))).alias("b"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(hashed)
    seal = F.to_json(F.struct(*[F.lit("x").alias(c) for c in ("ciphertext", "nonce", "key_id")], F.lit("ROT13").alias("algorithm")))
    inner = F.struct(name.alias("c_name"), hashed.alias("c_acctbal"), F.lit("[REDACTED]").alias("other"), deep.alias("a"), seal.alias("seal"))
    c = table(spark, d, "customer").select(name.alias("c_name"), F.to_json(F.struct(inner.alias("inner"))).alias("doc"))
    rules = {"c_name": "hash", "c_acctbal": "scrub", "other": "scrub", "seal": "encrypt"}
    return P.sweep_plaintext(c, rules, ("doc",)).groupBy("path", "field", "expected", "state").agg(F.count("*").alias("n"))


@query("rekey", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'successful' ELSE 'skipped' END AS outcome, count(*) AS n FROM customer GROUP BY 1")
def rekey(spark, d):
    _, counts = P.rekey(_sealed(spark, d), "envelope", ("k0", OTHER), ("k1", KEY))
    return counts


@query("rekey_values", "SELECT c_custkey, c_name AS plain FROM customer")
def rekey_values(spark, d):
    new, _ = P.rekey(_sealed(spark, d), "envelope", ("k0", OTHER), ("k1", KEY))
    plain, _ = P.decrypt_values(cut(new, "rekeyed"), "envelope", {"k1": KEY}, "a", "r", "c_name")
    return plain.select("c_custkey", "plain")


_MAIL = P.PATTERNS["email"]
_TEXTS = """t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -o_orderkey, 'born ' || strftime(o_orderdate, '%d/%m/%Y') || ' or ' || strftime(o_orderdate, '%Y-%m-%d') || ', no. '
|| printf('%03d-%02d-%04d', o_custkey % 1000, o_custkey % 100, o_custkey % 10000) || ', call ' || printf('555-%03d-%04d', o_custkey % 1000, o_orderkey % 10000) || '.' FROM orders)"""
_HITS = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS f FROM t" for k, p in (P.PATTERNS | P.MORE_PATTERNS).items())


@query("pii_scan", f"WITH {_TEXTS}, h AS ({_HITS}), e AS (SELECT id, kind, unnest(f) AS m, unnest(range(len(f)))::INT AS n_before FROM h) SELECT id, kind, n_before, sha256(m) AS match_hash FROM e")
def scan(spark, d):
    """All documents, and a line for each order with the forms that they lack."""
    number = F.format_string("%03d-%02d-%04d", F.col("o_custkey") % 1000, F.col("o_custkey") % 100, F.col("o_custkey") % 10000)
    phone = F.format_string("555-%03d-%04d", F.col("o_custkey") % 1000, F.col("o_orderkey") % 10000)
    born = F.concat(F.lit("born "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" or "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("doc_id"), F.concat(born, F.lit(", no. "), number, F.lit(", call "), phone, F.lit(".")).alias("text"))
    return P.scan_patterns(table(spark, d, "documents").select("doc_id", "text").unionByName(o), "doc_id", "text")


@query("key_inventory", """WITH n AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN 'k1' ELSE 'k0' END AS key_id, count(*) AS n FROM customer GROUP BY 1)
SELECT 'c_name' AS field, 'AES-256-GCM' AS algorithm, key_id, n, n / (SELECT sum(n) FROM n) AS part FROM n""")
def inventory(spark, d):
    return P.key_inventory(_sealed(spark, d).withColumn("f", F.lit("c_name")), "f", "envelope")


@query("mask_format", r"""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Xxxxxxxx#' || repeat('n', length(c_name) - 9) ELSE c_name END AS masked,
'xxxx' || '@example.com' AS mail FROM customer""")
def mask(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit("name").alias("f"), "c_name", F.lit("mail").alias("g"), F.lit("abcd@example.com").alias("m"))
    rules = {("MACHINERY", "name"): "full", (None, "mail"): "local"}
    x = P.mask_format(c, "c_mktsegment", "f", "c_name", rules).withColumnRenamed("masked", "a")
    return P.mask_format(x, "c_mktsegment", "g", "m", rules).select("c_custkey", F.col("a").alias("masked"), F.col("masked").alias("mail"))


@query("privacy_category", f"""WITH l AS (SELECT sha256(c_name) AS k, 'name' AS c FROM customer UNION ALL SELECT sha256(m), 'email' FROM (SELECT unnest(regexp_extract_all(text, '{_MAIL}')) AS m FROM documents))
SELECT DISTINCT k AS canonical_key, CASE c WHEN 'name' THEN 'personal' ELSE c END AS category FROM l""")
def category(spark, d):
    a = table(spark, d, "customer").select(F.lit("name").alias("column"), F.col("c_name").alias("canonical"))
    b = table(spark, d, "documents").select(F.lit("text").alias("column"), F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("canonical"))
    v = a.unionByName(b).withColumn("canonical_key", F.sha2("canonical", 256))
    return P.categorise(v, {"name": "personal"}, {"email": _MAIL})


@query("classified_view", """WITH c AS (SELECT 'c_custkey' AS field, CAST(NULL AS BIGINT) AS id, 0 AS level UNION ALL SELECT 'c_name', NULL, 2 UNION ALL SELECT 'c_mktsegment', NULL, 1
  UNION ALL SELECT 'c_nationkey', c_custkey, 0 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'c_mktsegment', c_custkey, 3 FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT NULL, c_custkey, 1 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT NULL, c_custkey, 2 FROM customer WHERE c_custkey % 7 = 0),
l AS (SELECT u.c_custkey, f.field, coalesce(max(c.level), 3) AS level FROM customer u CROSS JOIN (VALUES ('c_custkey'), ('c_name'), ('c_mktsegment'), ('c_nationkey')) AS f(field)
  LEFT JOIN c ON (c.id IS NULL AND c.field = f.field) OR (c.id = u.c_custkey AND coalesce(c.field, f.field) = f.field) GROUP BY 1, 2),
m AS (SELECT c_custkey, max(level) FILTER (field = 'c_custkey') AS k, max(level) FILTER (field = 'c_name') AS n, max(level) FILTER (field = 'c_mktsegment') AS s, max(level) FILTER (field = 'c_nationkey') AS t FROM l GROUP BY 1)
SELECT CASE WHEN k <= 1 THEN CAST(c_custkey AS VARCHAR) ELSE '[REDACTED]' END AS c_custkey, CASE WHEN n <= 1 THEN c_name ELSE '[REDACTED]' END AS c_name, CASE WHEN s <= 1 THEN c_mktsegment ELSE '[REDACTED]' END AS c_mktsegment,
  CASE WHEN t <= 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '[REDACTED]' END AS c_nationkey FROM customer JOIN m USING (c_custkey)""")
def view(spark, d):
    """Levels of fields, of one field in some rows, and of whole rows; a field without any is shown only where its row has one."""
    customer = table(spark, d, "customer")
    c = customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    fields = spark.createDataFrame([("c_custkey", None, "public"), ("c_name", None, "confidential"), ("c_mktsegment", None, "internal")], "field string, row long, level string")
    rows = [
        customer.filter(F.col("c_custkey") % n == 0).select(F.lit(f).cast("string").alias("field"), F.col("c_custkey").alias("row"), F.lit(level).alias("level"))
        for n, f, level in ((3, "c_nationkey", "public"), (4, "c_mktsegment", "high"), (5, None, "internal"), (7, None, "confidential"))
    ]
    classification = fields.unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    P.classified_view(c, classification, "internal", "c_custkey", "customers_for_internal")
    return spark.table("customers_for_internal")


@query("audit_by_actor", """SELECT event_type AS actor, 'f' || (user_id % 3) AS field, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
FROM events WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def by_actor(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("actor"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("field_name"), F.concat(F.lit("k"), F.col("user_id") % 2).alias("key_id"), F.col("ts").alias("timestamp")
    )
    x = P.audit_by_actor(e, "k0", F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return x.select("actor", "field", "n", f("first"), f("last"))


@query("policy_on_cells", """SELECT 'customer' AS "column", 'encrypted' AS state, count(o_custkey) AS n FROM orders UNION ALL SELECT 'status', 'redacted', count(o_orderstatus) FROM orders
UNION ALL SELECT 'priority', 'plain', count(o_orderpriority) FROM orders""")
def policy_on_cells(spark, d):
    """The policy over all cells, with an encrypt arm: only the state of each field is stable."""
    c = P.apply_policy(cells(spark, d), "column", "raw", {"customer": "encrypt", "status": "scrub"}, key=KEY)
    return P.protection_state(c, "protected").groupBy("column", "state").agg(F.count("*").alias("n"))
