"""Format-preserving pseudonyms for personal numbers and dates.

A value that passes the test of its kind is permuted within its format by a keyed
Feistel network: its digits (or its number of days, or its address) are split into two
halves, and in ten rounds a keyed hash of one half is added to the other. The result
is a value of the same kind and format, equal values have equal pseudonyms in all
documents, and whoever has the key can go back.

| kind | test | what is permuted |
| --- | --- | --- |
| card | 13 to 19 digits with a right check digit, in a run of groups of digits | all digits but the last, which becomes the check digit |
| phone | ``+`` country code, area, 3 and 4 digits; without a code, in brackets, by hyphens or by dots | the last ten digits |
| social | 3, 2 and 4 digits; not area 000, 666 or 900 and above, group 00 or number 0000 | its nine digits, again until the test is passed |
| date | a day from 1900-01-01 to 2101-01-26, as 2000-12-31, 12/31/2000 or 31.12.2000 | the number of the day |
| address | four numbers up to 255 | its 32 bits |
| mail | a mail address | the local part, by a keyed hash in letters (not a number, so not reversible) |

A run of digits may hold more than a card: a security code after it, a quantity before it,
several cards. If the run as a whole isn't one, all sub-runs of whole groups are tested; of
those that overlap, the usual groupings count first, then the longest, then the first. A
pseudonym by which the run would be read otherwise is permuted again until it isn't, so
that the way back finds the same values; only runs of more than ``WALKED`` values do without.

SQL expressions only, on values that the patterns find; nothing is shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

ROUNDS = 10
DAYS = 271  # squared: 73441 days
WALKED, WALKS = 4, 60
USUAL = ("4-4-4-4", "4-4-4-4-3", "4-6-5", "4-6-4")  # groupings of cards

#: Kinds by pattern, the first that fits counts. Fixed values.
PATTERNS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])|\([0-9]{3}\)[ -]?[0-9]{3}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9-])(?!\.[0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])(?!\.[0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# a whole run of groups, up to a value of another kind; a hyphen behind it is seen, so that no value ends there
PATTERNS["card"] = r"(?<![0-9-])[0-9](?:(?! (?:" + "|".join(PATTERNS[k] for k in ("mail", "phone", "address", "date", "social")) + r"))[ -]?[0-9]){12,}+-?"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, domain: str, a: str, b: str, ma: str, mb: str, back: bool = False) -> str:
    """SQL for the struct ``(a, b)`` after all rounds, ``a`` below ``ma`` and ``b`` below ``mb``."""
    mixed = lambda x: (
        f"cast(conv(substr(sha2(concat({_quote(key + ':' + domain + ':')}, r, ':', {x}), 256), 1, 12), 16, 10) as bigint)"
    )
    sign = "-" if back else "+"
    rounds = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    return (
        f"aggregate({rounds}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 0, "
        f"named_struct('a', pmod(s.a {sign} {mixed('s.b')} % ({ma}), {ma}), 'b', s.b), "
        f"named_struct('a', s.a, 'b', pmod(s.b {sign} {mixed('s.a')} % ({mb}), {mb}))))"
    )


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(key: str, domain: str, d: str, back: bool) -> str:
    """The permuted digits of ``d``, an expression for 2 to 18 digits."""
    half = "cast(length(d) / 2 as int)"
    low, high = f"pow10[{half}]", f"pow10[length(d) - {half}]"
    run = _feistel(key, domain, f"substr(d, 1, {half})", f"substr(d, {half} + 1)", low, high, back)
    joined = f"concat(lpad(cast(f.a as string), {half}, '0'), lpad(cast(f.b as string), length(d) - {half}, '0'))"
    powers = "array(" + ", ".join(f"{10**i}L" for i in range(11)) + ")"
    return _let(d, "d", _let(powers, "pow10", _let(run, "f", joined)))


def _refill(m: str, digits: str) -> str:
    """``m`` with its digits replaced by those of ``digits``, in order."""
    return _let(
        digits, "fresh",
        f"array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) between '0' and '9', "
        f"substr(fresh, length(regexp_replace(substr({m}, 1, i), '[^0-9]', '')), 1), substr({m}, i, 1))), '')",
    )


def _check_sum(d: str, first_doubled: int) -> str:
    """The sum of a card number's digits, every second doubled, counted from the right end."""
    x = f"cast(substr({d}, length({d}) - i, 1) as int) * if(i % 2 = {first_doubled}, 2, 1)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + {_let(x, 'x', 'if(x > 9, x - 9, x)')})"


def _bare(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _cards(m: str) -> str:
    """SQL for the cards in a run of groups: an array of ``(start, size)``, none overlapping."""
    d = "array_join(slice(g, i + 1, j - i + 1), '')"
    usual = "array_join(transform(slice(g, i + 1, j - i + 1), x -> length(x)), '-') in (" + ", ".join(map(_quote, USUAL)) + ")"
    rank = f"case when i = 0 and j = size(g) - 1 then 0 when i = j or {usual} then 1 else 2 end"
    # the last group of a run with a hyphen behind it is followed by an empty one
    fits = f"length(d) between 13 and 19 and g[j] <> '' and coalesce(get(g, j + 1), 'x') <> '' and {_check_sum('d', 1)} % 10 = 0"
    test = _let(d, "d", f"if({fits}, named_struct('rank', {rank}, 'less', -length(d), 'i', i, 'j', j), null)")
    from_i = f"filter(transform(sequence(i, least(i + 18, size(g) - 1)), j -> {test}), c -> c is not null)"
    every = f"array_sort(flatten(transform(sequence(0, size(g) - 1), i -> {from_i})))"
    chosen = "aggregate(every, filter(every, c -> false), (acc, c) -> if(exists(acc, a -> a.i <= c.j and c.i <= a.j), acc, concat(acc, array(c))))"
    place = "named_struct('start', length(array_join(slice(g, 1, c.i), ' ')) + if(c.i > 0, 2, 1), 'size', length(array_join(slice(g, c.i + 1, c.j - c.i + 1), ' ')))"
    return _let(f"split({m}, '[ -]', -1)", "g", _let(every, "every", f"transform({chosen}, c -> {place})"))


def _pseudonym(kind: str, key: str, back: bool) -> str:
    """SQL for the pseudonym of ``m``, null where it isn't a value of its kind; of a card's run with ``found`` in it."""
    if kind == "card":
        body = _digits(key, "card", "substr(n, 1, length(n) - 1)", back)
        whole = _let(body, "p", f"concat(p, cast(pmod(10 - {_check_sum('p', 0)} % 10, 10) as string))")
        one = _let("substr(u, c.start, c.size)", "z", _let(_bare("z"), "n", f"concat(left(u, c.start - 1), {_refill('z', whole)}, substr(u, c.start + c.size))"))
        step = f"aggregate(found, y.t, (u, c) -> {one})"
        again = _let(step, "v", f"named_struct('t', v, 'ok', size(found) > {WALKED} or {_cards('v')} = found)")
        walked = f"aggregate(sequence(1, {WALKS}), named_struct('t', m, 'ok', false), (y, q) -> if(y.ok, y, {again})).t"
        return f"if(size(found) > 0, {walked}, null)"
    if kind == "phone":
        n = _bare("m")
        body = f"concat(substr(n, 1, length(n) - 10), {_digits(key, 'phone', 'right(n, 10)', back)})"
        return _let(n, "n", _refill("m", body))
    if kind == "social":
        fine = lambda x: f"substr({x}, 1, 3) not in ('000', '666') and substr({x}, 1, 1) <> '9' and substr({x}, 4, 2) <> '00' and substr({x}, 6) <> '0000'"
        step = _let(_digits(key, "social", "y.t", back), "v", f"named_struct('t', v, 'ok', {fine('v')})")
        walked = f"aggregate(sequence(1, {WALKS}), named_struct('t', n, 'ok', false), (y, q) -> if(y.ok, y, {step})).t"
        return _let(_bare("m"), "n", f"if({fine('n')}, {_refill('m', walked)}, null)")
    if kind == "date":
        day = "coalesce(try_to_date(m, 'yyyy-MM-dd'), try_to_date(m, 'MM/dd/yyyy'), try_to_date(m, 'dd.MM.yyyy'))"
        first = "date'1900-01-01'"
        run = _feistel(key, "date", f"cast(n / {DAYS} as int)", f"n % {DAYS}", str(DAYS), str(DAYS), back)
        fresh = _let(run, "f", f"date_format(date_add({first}, cast(f.a * {DAYS} + f.b as int)), case when m like '%/%' then 'MM/dd/yyyy' when m like '%.%' then 'dd.MM.yyyy' else 'yyyy-MM-dd' end)")
        return _let(f"datediff({day}, {first})", "n", f"if(n between 0 and {DAYS * DAYS - 1}, {fresh}, null)")
    if kind == "address":
        parts = "transform(split(m, '[.]'), x -> cast(x as int))"
        run = _feistel(key, "address", "p[0] * 256 + p[1]", "p[2] * 256 + p[3]", "65536", "65536", back)
        fresh = _let(run, "f", "concat_ws('.', cast(f.a / 256 as int), f.a % 256, cast(f.b / 256 as int), f.b % 256)")
        return _let(parts, "p", f"if(forall(p, x -> x < 256), {fresh}, null)")
    word = f"translate(substr(sha2(concat({_quote(key + ':mail:')}, lower(m)), 256), 1, 12), '0123456789', 'ghijklmnop')"
    return "null" if back else f"concat({word}, substr(m, instr(m, '@')))"


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), back: bool = False
) -> DataFrame:
    """``(id, n_<kind>..., text)`` for every row of ``docs``.

    ``n_<kind>`` counts the values replaced. With ``back`` and the same key, all kinds
    but ``mail`` are turned back. Texts without such values stay as they are, null
    texts stay null with counts of 0; the whole text is searched; ids may repeat or be
    null, rows that repeat are treated alike. Values that fail their test stay. An empty table gives
    no rows; other columns are not looked at.
    """
    every = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS if k in kinds)
    kind = "case " + " ".join(
        f"when m rlike {_quote('^(?:' + PATTERNS[k] + ')$')} then {_quote(k)}" for k in PATTERNS if k in kinds and k != "card"
    ) + (" else 'card' end" if "card" in kinds else " end")  # what follows a run has a say in it, and isn't in m
    if kinds == ("card",):
        kind = "'card'"
    fresh = "case k " + " ".join(f"when {_quote(k)} then {_pseudonym(k, key, back)}" for k in PATTERNS if k in kinds) + " end"
    none = "array(named_struct('start', 1, 'size', 1))"  # of other kinds each match is one value
    found = f"if(k = 'card', {_cards('m')}, {none})"
    one = _let(kind, "k", _let(found, "found", f"named_struct('m', m, 'k', k, 'n', size(found), 'p', {fresh})"))
    p = _quote(every)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.withColumn("hits", F.expr(f"transform(regexp_extract_all(text, {p}, 0), m -> {one})"))
    counts = [
        F.coalesce(F.expr(f"aggregate(filter(hits, h -> h.k = {_quote(k)} and h.p is not null), 0, (t, h) -> t + h.n)"), F.lit(0)).cast("long").alias(f"n_{k}")
        for k in PATTERNS if k in kinds
    ]
    glued = (
        f"case when size(hits) > 0 then {_let(f'split(text, {p}, -1)', 'parts', 'array_join(transform(parts, (x, i) -> concat(x, coalesce(get(hits, i).p, get(hits, i).m, ' + _quote('') + '))), ' + _quote('') + ')')} else text end"
    )
    return d.select(F.col("id").alias(id_col), *counts, F.expr(glued).alias(text_col))


def op3_pseudonyms(spark, sf_dir):
    """Every document with pseudonyms for its personal values."""
    key = spark.conf.get("spark.tracewell.pseudonym.key", None)
    if not key:
        warnings.warn("spark.tracewell.pseudonym.key is not set: pseudonyms are made with a public key and hide nothing", stacklevel=2)
        key = "not a secret"
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
