"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has as many words as the corpus. Sources share it by weight, up to a
limit of repeats. The share is dealt in blocks of equal size: blocks go to the
sources with the highest quotients ``target / (2 k + 1)``, then in the same way to
the shards of each source. Inside a shard, documents stand in a seeded order, end to
end; a shard takes its blocks from the front of that line, and goes round again where
its quota is more than it has.

Only word counts are shuffled, never texts. Shards hold about ``shard_words`` words, so
a hot source has as many of them as it needs, and no step gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.rows import free, row_hash
from tracewell.operators.ordering import with_running
from tracewell.scratch import cut

WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], repeats: float) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights``, repeating. All words are
    shared by weight; a target stops at ``repeats`` times its source's size and the
    excess is shared again among the rest, until none is above. The result of that
    is ``min(repeats * size, level * weight)`` with one level for all sources; it is
    found from running sums over the sources, sorted by where they stop.
    """
    ranked = with_running(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, len(weights)) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    ranked = cut(ranked.withColumn("stop", F.col("most") / F.col("weight")), "mix-sources")
    whole = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, all_weight = float(whole["t"] or 0), float(whole["w"] or 0)
    run = with_running(ranked, [F.col("stop"), F.col("rank")], "at", {"m": "most", "v": "weight"})
    # the level if all sources before this one have stopped; this one stops if that is above its own
    rest = F.lit(total) - (F.col("m") - F.col("most"))
    level_before = rest / (F.lit(all_weight) - (F.col("v") - F.col("weight")))
    stopped = run.filter(level_before > F.col("stop")).agg(
        F.sum("most").alias("m"), F.sum("weight").alias("v")
    ).first()
    left, of = total - float(stopped["m"] or 0), all_weight - float(stopped["v"] or 0)
    level = left / of if of > 1e-12 else float("inf")
    return ranked.select(
        "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target")
    )


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the seats of its group that each party wins.

    A party's ``k``-th seat has the quotient ``votes / (2 k + 1)``; the highest quotients of
    a group win, the smaller party name where they tie. With n parties, the seats
    of a party differ from its exact share by at most n / 2 times its part of the
    votes plus a half, so all lower seats are certain and only the few quotients
    around that bound (three a party) are ranked. Groups without votes have quota 0.
    """
    whole = parties.groupBy(group).agg(F.sum(votes).alias("_votes"), F.count("*").alias("_n"))
    p = parties.join(whole, group).withColumn("_part", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")))
    exact, wide = F.col(seats) * F.col("_part"), F.col("_part") * F.col("_n") / 2 + 1
    p = p.withColumns({"_low": F.greatest(F.lit(0), F.floor(exact - wide)).cast("long"), "_high": F.ceil(exact + wide).cast("long")})
    p = cut(p, "mix-parties")
    open_ = p.groupBy(group).agg(F.first(seats).alias("_seats"), F.sum("_low").alias("_given"))
    tries = p.filter("_part is not null").select(
        group, party, votes, F.explode(F.expr("sequence(_low, _high)")).alias("_k")
    ).withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
    ranked = with_running(tries, [F.col(group), F.col("_quotient").desc(), F.col(party), F.col("_k")], "_rank")
    starts = ranked.groupBy(group).agg(F.min("_rank").alias("_start")).join(open_, group)
    won = (
        ranked.join(starts, group)
        .filter(F.col("_rank") - F.col("_start") < F.col("_seats") - F.col("_given"))
        .groupBy(group, party)
        .agg(F.count("*").alias("_won"))
    )
    out = p.join(won, [group, party], "left")
    quota = F.when(F.col("_part").isNull(), 0).otherwise(F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long")
    return out.withColumn("quota", quota).drop("_votes", "_n", "_part", "_low", "_high", "_won")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    repeats: int = 3,
    block: int = 8,
    shard_words: int = 1_000_000,
    seed: str = "mix",
) -> DataFrame:
    """``(id, row, size, source_size, target, taken)`` for every row of ``docs``.

    ``row`` is the hash that :func:`rows.row_hash` gives.

    ``taken`` counts the words of a document that the mix takes, repeats included; it
    is at most ``repeats * size``. A source takes its target to within a block a
    shard. The same rows give the same mix: the order in a shard depends on the
    seed, the id and the text alone. A null text has size 0, a null source is a source of
    its own, a null id is a value like others. Rows that repeat are documents of
    their own. Texts may have any length, other columns are not looked at. An empty table gives no rows; a corpus
    without words takes none.
    """
    # the text too, so that rows of one id, or of none, don't all fall into one shard
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(text_col, F.lit("")))))
    rows = docs.select(
        F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("row"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), seeded.alias("h"),
    )
    rows = cut(rows, "mix-sizes")
    shares = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), repeats), "mix-targets")
    sum_size = shares.agg(F.sum("source_size")).first()[0] or 0
    blocks = shares.select(
        F.lit(0).alias("all"), F.struct(F.col("source").isNull().alias("last"), "source").alias("name"), "source_size", "target",
        F.lit(round(sum_size / block)).cast("long").alias("seats"),
    )
    blocks = cut(blocks, "mix-blocks")  # so that the join on its one group is an equi-join
    quotas = sainte_lague(blocks, "all", "name", "target", "seats").select(
        "name", "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))).cast("long").alias("shards"),
    )
    quotas = cut(quotas, "mix-quotas")
    placed = rows.withColumn("name", F.struct(F.col("source").isNull().alias("last"), "source")).join(quotas, "name")
    at = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("shard", F.pmod(at, F.col("shards")))
    shards = placed.groupBy("name", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    won = sainte_lague(shards, "name", "shard", "shard_size", "source_quota").select(
        "name", "shard", "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * repeats).alias("words"),
    )
    line = Window.partitionBy("name", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(won, ["name", "shard"])
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")
    over = F.col("words") - rounds * F.col("shard_size") - F.col("start")
    taken = rounds * F.col("size") + F.least(F.greatest(over, F.lit(0)), F.col("size"))
    return placed.select(F.col("id").alias(id_col), "row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_mix_sources(spark, sf_dir):
    """The words that the mix takes of every document."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, with ``taken``, the words it takes of each.

    Documents of which nothing is taken go, so null and empty texts do. Each of some rows that repeat
    takes the same part of what is taken of them all, rounded up. Null ids and sources are values like
    others. Columns stay as they are; where documents have a column ``taken``, underscores
    are added to the new one's name. An empty table gives no rows.
    """
    own, its_id, its_row, taken = free(docs, "own", "its_id", "its_row", "taken")
    won = mix_sources(docs).groupBy("doc_id", "row").agg(F.ceil(F.sum("taken") / F.count("*")).alias(taken)).filter(F.col(taken) > 0)
    won = cut(won.select(F.col("doc_id").alias(its_id), F.col("row").alias(its_row), taken), "mix-taken")
    same = (F.col(own) == F.col(its_row)) & F.col("doc_id").eqNullSafe(F.col(its_id))
    return docs.withColumn(own, row_hash("doc_id", "text")).join(won, same).drop(own, its_id, its_row)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CAST([5, 2, 1][(rnk - 1) % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most FROM k),
v AS (SELECT *, most / weight AS stop, (SELECT sum(source_size) FROM s) AS t, (SELECT sum(weight) FROM w) AS tw FROM w),
l AS (SELECT *, (t - coalesce(sum(most) OVER o, 0)) / (tw - coalesce(sum(weight) OVER o, 0)) AS before
      FROM v WINDOW o AS (ORDER BY stop, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (max(t) - coalesce(sum(most) FILTER (before > stop), 0)) /
      nullif(max(tw) - coalesce(sum(weight) FILTER (before > stop), 0), 0) AS lev FROM l),
g AS (SELECT source, source_size, least(most, weight * coalesce(lev, 1e300)) AS target,
      CAST(round((SELECT sum(source_size) FROM s) / 8.0) AS BIGINT) AS seats,
      greatest(1, CAST(ceil(source_size / 1e6) AS BIGINT)) AS shards FROM l, c),
q1 AS (SELECT source, target, unnest(range(0, CAST(ceil(target / 8 + 2 + (SELECT count(*) FROM s)) AS BIGINT))) AS j, seats FROM g),
q2 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) AS r, seats FROM q1 WHERE target > 0),
q AS (SELECT source, count(*) AS quota FROM q2 WHERE r <= seats GROUP BY source),
p AS (SELECT d.*, g.source_size, g.target, coalesce(q.quota, 0) AS quota, CAST('0x' || substr(h, 1, 8) AS BIGINT) % g.shards AS shard
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
z AS (SELECT source, shard, any_value(quota) AS quota, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_size) AS source_size FROM p GROUP BY source, shard),
y1 AS (SELECT source, shard, shard_size, quota, unnest(range(0, CAST(ceil(quota * shard_size / source_size + 2 + (SELECT count(*) FROM z)) AS BIGINT))) AS j FROM z WHERE shard_size > 0),
y2 AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, shard, j) AS r FROM y1),
y AS (SELECT source, shard, count(*) AS won FROM y2 WHERE r <= quota GROUP BY source, shard),
x AS (SELECT p.*, z.shard_size, least(coalesce(y.won, 0) * 8, z.shard_size * 3) AS words,
      coalesce(sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY h, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM p JOIN z ON p.source IS NOT DISTINCT FROM z.source AND p.shard = z.shard
      LEFT JOIN y ON p.source IS NOT DISTINCT FROM y.source AND p.shard = y.shard)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN shard_size > 0 THEN (words // shard_size) * size + least(greatest(words % shard_size - start, 0), size) ELSE 0 END AS BIGINT) AS taken
FROM x
"""
