"""Privacy jobs: policy, hashing, encryption, audited decryption, sweeps and scans."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.scratch import cut
from tracewell.tables import ENVELOPE

REDACTED = "[REDACTED]"
ALGORITHM = "AES-256-GCM"
#: Patterns of personal data in text. Fixed values.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b",
    "phone": r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
    "birth_date": r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b",
}
#: Two more forms, our own: an area code in brackets, and ISO dates.
MORE_PATTERNS = {"phone_in_brackets": r"[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}\b", "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _hashed(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(c, 256)))


def _envelope(c: Column, key: bytes, key_id: str) -> Column:
    """JSON of nonce and ciphertext (with tag); a fresh nonce at every evaluation."""
    raw = F.aes_encrypt(c, F.lit(key), F.lit("GCM"))
    # the ciphertext must be split from one and the same encryption
    one = F.transform(
        F.array(raw),
        lambda r: F.to_json(
            F.struct(
                F.base64(F.substr(r, F.lit(13))).alias("ciphertext"), F.base64(F.substr(r, F.lit(1), F.lit(12))).alias("nonce"),
                F.lit(key_id).alias("key_id"), F.lit(ALGORITHM).alias("algorithm"),
            )
        ),
    )
    return F.when(c.isNotNull(), one[0])


def _opened(env: Column, keys: dict[str, bytes]) -> Column:
    whole = F.concat(F.unbase64(env["nonce"]), F.unbase64(env["ciphertext"]))
    plain = F.lit(None).cast("string")
    for key_id, key in keys.items():
        plain = F.when(env["key_id"] == key_id, F.try_aes_decrypt(whole, F.lit(key), F.lit("GCM")).cast("string")).otherwise(plain)
    return plain


def apply_policy(
    df: DataFrame, field_col: str, value_col: str, rules: dict[str, str], default: str = "passthrough", key: bytes | None = None, key_id: str = "k1"
) -> DataFrame:
    """``protected`` by the field's rule: scrub, hash, encrypt or passthrough.

    What can't be protected (no key, an unknown rule) is redacted. Null values stay null.
    """
    v = F.col(value_col)
    rule = F.coalesce(_map(rules)[F.col(field_col)], F.lit(default)) if rules else F.lit(default)
    encrypted = _envelope(v, key, key_id) if key is not None and len(key) == 32 else F.lit(None).cast("string")
    out = F.when(rule == "passthrough", v).when(rule == "hash", _hashed(v)).when(rule == "encrypt", encrypted)
    return df.withColumn("protected", F.when(v.isNotNull(), F.coalesce(out, F.lit(REDACTED))))


def hash_values(df: DataFrame, col: str) -> DataFrame:
    """One-way hashes, ``sha256:`` and 64 digits."""
    return df.withColumn("hashed", _hashed(F.col(col)))


def encrypt_values(df: DataFrame, col: str, key: bytes, key_id: str) -> DataFrame:
    """``envelope``. Write the result before using it twice: nonces are random."""
    return df.withColumn("envelope", _envelope(F.col(col), key, key_id))


def decrypt_values(df: DataFrame, col: str, keys: dict[str, bytes], actor: str, reason: str, field: str, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``plain`` for each row, and an audit row for every attempt, failed ones too."""
    env = F.from_json(F.col(col), ENVELOPE)
    d = df.withColumn("_env", env).withColumn("plain", _opened(F.col("_env"), keys))
    known = F.col("_env.key_id").isin(*keys)
    status = F.when(F.col("plain").isNotNull(), "ok").when(F.col("_env.ciphertext").isNull(), "no_envelope").when(~known, "unknown_key").otherwise("refused")
    audit = d.filter(F.col(col).isNotNull()).select(
        F.lit(actor).alias("actor"), F.lit(reason).alias("reason"), (at if at is not None else F.current_timestamp()).alias("timestamp"), F.lit(field).alias("field_name"),
        F.col("_env.key_id").alias("key_id"), status.alias("status"),
    )
    return d.drop("_env"), audit


def state_of(c: Column) -> Column:
    env = F.from_json(F.when(c.startswith("{"), c), ENVELOPE)
    sealed = env["ciphertext"].isNotNull() & env["nonce"].isNotNull() & env["key_id"].isNotNull() & (env["algorithm"] == ALGORITHM)
    return (
        F.when(c.isNull(), None)
        .when(c.rlike("^sha256:[0-9a-f]{64}$"), "hashed")
        .when(c == REDACTED, "redacted")
        .when(F.coalesce(sealed, F.lit(False)), "encrypted")
        .otherwise("plain")
    )


def protection_state(df: DataFrame, col: str) -> DataFrame:
    """P5: hashed, encrypted (an envelope of the algorithm in use), redacted or plain."""
    return df.withColumn("state", state_of(F.col(col)))


_WANTED = {"hash": "hashed", "encrypt": "encrypted", "scrub": "redacted"}


def _members(column: str, wanted: set[str]):
    """``(path, field, v)`` of the wanted string members of JSON texts, at any depth and however often a name repeats; what isn't JSON has none."""

    def walk(text: str):
        try:
            # an object is its pairs, told from an array by being a tuple
            open_ = [(column, json.loads(text, object_pairs_hook=tuple))]
        except (ValueError, RecursionError):
            return
        while open_:
            path, v = open_.pop()
            pairs = v if isinstance(v, tuple) else enumerate(v)
            for name, x in pairs:
                at = f"{path}.{name}"
                if isinstance(x, (tuple, list)):
                    open_.append((at, x))
                elif isinstance(x, str) and isinstance(v, tuple) and name in wanted:
                    yield at, name, x

    def run(batches):
        for b in batches:
            found = [m for text in b.column(0).to_pylist() if text is not None and text.lstrip()[:1] in ("{", "[") for m in walk(text)]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in found], pa.string()) for i in range(3)], ["path", "field", "v"])

    return run


def sweep_plaintext(df: DataFrame, rules: dict[str, str], json_cols: tuple[str, ...] = ()) -> DataFrame:
    """``(path, field, expected, state)`` of every protected field that isn't protected as its rule says.

    Columns by their names, and members of JSON columns at any depth, in one pass that writes nothing and carries no
    more than the fields that have a rule. Only strings are looked at, nulls are left out.
    """
    wanted = {f: _WANTED[r] for f, r in rules.items() if r in _WANTED}
    out = df.select(F.lit("").alias("path"), F.lit("").alias("field"), F.lit("").alias("v")).limit(0)
    for c in df.columns:
        if c in wanted:
            out = out.unionByName(df.select(F.lit(c).alias("path"), F.lit(c).alias("field"), F.col(c).cast("string").alias("v")))
    for c in json_cols if wanted else ():
        out = out.unionByName(df.select(F.col(c).cast("string").alias("v")).mapInArrow(_members(c, set(wanted)), "path string, field string, v string"))
    out = out.filter(F.col("v").isNotNull())
    out = out.withColumns({"state": state_of(F.col("v")), "expected": _map(wanted)[F.col("field")] if wanted else F.lit(None).cast("string")})
    return out.filter("state <> expected").select("path", "field", "expected", "state")


def rekey(df: DataFrame, col: str, old: tuple[str, bytes], new: tuple[str, bytes]) -> tuple[DataFrame, DataFrame]:
    """Envelopes under the old key sealed anew; counts by outcome. Write the frame before reuse."""
    env = F.from_json(F.col(col), ENVELOPE)
    d = df.withColumn("_env", env)
    d = d.withColumn("_plain", F.when(F.col("_env.key_id") == old[0], _opened(F.col("_env"), {old[0]: old[1]})))
    outcome = F.when(F.col("_plain").isNotNull(), "successful").when(F.col("_env.key_id") == old[0], "failed").otherwise("skipped")
    d = d.withColumn("outcome", outcome)
    counts = d.groupBy("outcome").agg(F.count("*").alias("n"))
    d = d.withColumn(col, F.when(F.col("outcome") == "successful", _envelope(F.col("_plain"), new[1], new[0])).otherwise(F.col(col)))
    return d.drop("_env", "_plain", "outcome"), counts


def scan_patterns(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = PATTERNS | MORE_PATTERNS) -> DataFrame:
    """``(id, kind, n_before, match_hash)`` for each hit; ``n_before`` numbers the hits of a kind."""
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text_col, F.lit(p), F.lit(0)).alias("found")) for k, p in patterns.items()])
    d = df.select(F.col(id_col).alias("id"), F.explode(hits).alias("h"))
    d = d.select("id", "h.kind", F.posexplode("h.found").alias("n_before", "match"))
    return d.select("id", "kind", "n_before", F.sha2("match", 256).alias("match_hash"))


def key_inventory(df: DataFrame, field_col: str, col: str) -> DataFrame:
    """Encrypted values by field, algorithm and key, with each key's part of the field."""
    env = F.from_json(F.col(col), ENVELOPE)
    d = df.select(F.col(field_col).alias("field"), env.alias("e")).filter("e.ciphertext is not null")
    d = d.groupBy("field", "e.algorithm", "e.key_id").agg(F.count("*").alias("n"))
    whole = d.groupBy("field").agg(F.sum("n").alias("_all"))
    return d.join(whole, "field").select("field", "algorithm", "key_id", "n", (F.col("n") / F.col("_all")).alias("part"))


def mask_format(df: DataFrame, provider_col: str, field_col: str, value_col: str, rules: dict[tuple[str | None, str], str]) -> DataFrame:
    """P10: ``masked`` by the rule for provider and field, or for the field at any provider (None).

    ``full`` masks letters and digits in their places, ``local`` only the local part of an e-mail.
    """
    v = F.col(value_col)
    rule = F.lit(None).cast("string")
    for (provider, field), r in sorted(rules.items(), key=lambda x: x[0][0] is not None):
        here = F.col(field_col) == field
        rule = F.when(here if provider is None else here & (F.col(provider_col) == provider), r).otherwise(rule)
    at = F.length(v) - F.instr(F.reverse(v), "@") + 1
    local = F.concat(F.mask(F.substr(v, F.lit(1), at - 1)), F.substr(v, at))
    out = F.when(rule == "full", F.mask(v)).when((rule == "local") & v.contains("@"), local).when(rule.isNotNull(), F.mask(v)).otherwise(v)
    return df.withColumn("masked", out)


def categorise(values: DataFrame, rules: dict[str, str], patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """``(canonical_key, category)`` by field rule and by patterns in the value."""
    by_field = values.select("canonical_key", _map(rules)[F.col("column")].alias("category"))
    found = F.array(*[F.when(F.col("canonical").rlike(p), F.lit(k)) for k, p in patterns.items()])
    by_form = values.select("canonical_key", F.explode(found).alias("category"))
    return by_field.unionByName(by_form).dropna().distinct()


LEVELS = ("public", "internal", "confidential", "high")


def _rank(level: Column) -> Column:
    """A level as a number; what is no level counts as the highest."""
    return F.coalesce(_map({x: str(i) for i, x in enumerate(LEVELS)})[level].cast("int"), F.lit(len(LEVELS) - 1))


def classified_view(df: DataFrame, classification: DataFrame, clearance: str, id_col: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a reader of this clearance may see it, values above it redacted; with ``name`` also published as a view.

    ``classification`` has ``(field, row, level)``: a field in all rows (``row`` null), a field of one row, or one whole row (``field`` null), by
    the row's ``id_col``. A value has the highest level of those that apply; one that has none, and one whose level is
    unknown, counts as the highest. Nulls stay null. Fields are one row of levels; rows are one left join.
    """
    c = classification.select(F.coalesce("field", F.lit("*")).alias("_field"), F.col("row").cast("string").alias("_row"), _rank(F.col("level")).alias("_level"))
    levels = lambda d: F.map_from_entries(F.collect_list(F.struct("_field", "_level")))  # noqa: E731  a level a column
    fields = c.filter("_row is null").groupBy("_field").agg(F.max("_level").alias("_level")).agg(levels(c).alias("_by_field")).withColumn("_one", F.lit(1))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(fields), "_one", "left").withColumn("_by_row", F.lit(None).cast("map<string,int>"))
    if id_col is not None:
        rows = c.filter("_row is not null").groupBy("_row", "_field").agg(F.max("_level").alias("_level")).groupBy("_row").agg(levels(c).alias("_by_row"))
        d = d.drop("_by_row").withColumn("_id", F.col(id_col).cast("string")).join(rows, F.col("_id") == F.col("_row"), "left")
    allowed = LEVELS.index(clearance)

    def shown(x: str) -> Column:
        level = F.greatest(F.col("_by_field")[x], F.col("_by_row")[x], F.col("_by_row")["*"])
        value = F.col(x)
        masked = F.lit(REDACTED) if df.schema[x].dataType.simpleString() == "string" else F.lit(None).cast(df.schema[x].dataType)
        return F.when(F.coalesce(level, F.lit(len(LEVELS) - 1)) <= allowed, value).when(value.isNotNull(), masked).alias(x)

    out = d.select(*[shown(x) for x in df.columns])
    if name:
        out.createOrReplaceTempView(name)
    return out


def audit_by_actor(audit: DataFrame, key_id: str, since: Column, until: Column) -> DataFrame:
    """Decryptions under a key in ``[since, until)`` by actor and field."""
    d = audit.filter((F.col("key_id") == key_id) & (F.col("timestamp") >= since) & (F.col("timestamp") < until))
    return d.groupBy("actor", F.col("field_name").alias("field")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
